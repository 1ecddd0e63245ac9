"""Style strings ``k=v;k=v`` and colours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessella.functions.paths import let

# Font style bits.
BOLD, ITALIC, UNDERLINE = 1, 2, 4


def value(style: Column, key: str) -> Column:
    """First value of ``key``; NULL when absent (later duplicates do not count)."""
    parts = F.split(style, ";")
    hit = F.filter(parts, lambda p: (F.instr(p, "=") > 0) & (F.trim(F.substring_index(p, "=", 1)) == key))
    return F.trim(F.regexp_replace(F.get(hit, F.lit(0)), "^[^=]*=", ""))


def number(style: Column, key: str, default: float | None = None) -> Column:
    return F.coalesce(value(style, key).try_cast("double"), F.lit(default).cast("double"))


def is_text(style: Column) -> Column:
    parts = F.filter(F.transform(F.split(style, ";"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)) == "text", F.lit(False)) | F.coalesce(F.lower(value(style, "shape")) == "text", F.lit(False))


def font_flags(text: Column) -> Column:
    n = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    n = F.coalesce(n, F.lit(0))
    return F.struct(
        (n.bitwiseAND(BOLD) != 0).alias("bold"), (n.bitwiseAND(ITALIC) != 0).alias("italic"), (n.bitwiseAND(UNDERLINE) != 0).alias("underline")
    )


# --- colours ------------------------------------------------------------------
def _hex(s: Column, pos: int, n: int) -> Column:
    digits = F.substring(s, pos, n)
    return F.conv(F.concat(digits, digits) if n == 1 else digits, 16, 10).cast("int")


def _channels(h: Column) -> Column:
    """Three or six hex digits as an (r, g, b) struct, else NULL."""
    long, short = h.rlike("^[0-9A-Fa-f]{6}$"), h.rlike("^[0-9A-Fa-f]{3}$")
    cs = [F.when(long, _hex(h, 1 + 2 * i, 2)).when(short, _hex(h, 1 + i, 1)) for i in range(3)]
    return F.when(long | short, F.struct(*[c.alias(n) for c, n in zip(cs, "rgb")]))


def light_part(color: Column) -> Column:
    """First argument of ``light-dark(a, b)``, with brackets inside it respected."""
    inner = F.regexp_extract(color, r"^light-dark\s*\((.*)\)$", 1)
    first = F.regexp_extract(inner, r"^\s*((?:[^,()]|\([^()]*\))*)", 1)
    return F.when(color.rlike(r"^light-dark\s*\(.*\)$"), F.trim(first)).otherwise(color)


def rgb(color: Column) -> Column:
    """#RGB, #RRGGBB, rgb(r, g, b) or light-dark(...) as struct(r, g, b); NULL otherwise."""
    c = light_part(F.trim(color))
    pattern = r"^rgb\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$"
    triple = F.struct(*[F.regexp_extract(c, pattern, i + 1).try_cast("int").alias(n) for i, n in enumerate("rgb")])
    return F.when(c.startswith("#"), _channels(F.substring(c, 2, 100))).when(c.rlike(pattern), triple)


def hex_of(c: Column) -> Column:
    return F.format_string("#%02x%02x%02x", c["r"], c["g"], c["b"])


def plain_rgb(hex_color: Column) -> Column:
    """Hex colour with or without a leading #."""
    return _channels(F.regexp_replace(hex_color, "^#+", ""))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two hex colours; 0 when either cannot be read."""

    def measured(pair):
        p, q = pair["p"], pair["q"]
        d = (p["r"] - q["r"]) * (p["r"] - q["r"]) + (p["g"] - q["g"]) * (p["g"] - q["g"]) + (p["b"] - q["b"]) * (p["b"] - q["b"])
        return F.when(p.isNull() | q.isNull(), 0.0).otherwise(F.sqrt(d.cast("double")))

    return let(F.struct(plain_rgb(a).alias("p"), plain_rgb(b).alias("q")), measured)


def dark_to_black(color: Column) -> Column:
    """Dark greys become #000000; everything else keeps its digits."""

    def judged(h):
        def dark(c):
            spread = F.greatest(F.abs(c["r"] - c["g"]), F.abs(c["g"] - c["b"]), F.abs(c["r"] - c["b"]))
            return F.coalesce(((c["r"] + c["g"] + c["b"]) / 3 < 80) & (spread < 40), F.lit(False))

        return F.when(let(F.when(F.length(h) == 6, _channels(h)), dark), "#000000").otherwise(F.concat(F.lit("#"), h))

    return F.when(F.coalesce(color, F.lit("")) == "", "#000000").otherwise(let(F.regexp_replace(color, "^#+", ""), judged))
