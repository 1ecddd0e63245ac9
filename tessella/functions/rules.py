"""Small decision rules over element, region, text and style columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Element types per drawing layer; anything else is layer 5.
LAYERS = {
    0: ["section_panel", "title_bar"],
    1: [
        "rectangle", "rounded_rectangle", "rounded rectangle", "diamond", "ellipse", "circle",
        "cylinder", "cloud", "hexagon", "triangle", "parallelogram", "actor",
    ],
    2: ["icon", "picture", "image", "logo", "chart", "function_graph"],
    3: ["arrow", "line", "connector"],
    4: ["text"],
}
IMAGE_TYPES = ["icon", "picture", "logo", "chart", "function_graph", "image"]

# Prompt groups with score threshold, minimum area and priority.
PROMPT_GROUPS = {
    "image": (0.5, 100, 2),
    "arrow": (0.45, 50, 4),
    "shape": (0.5, 200, 3),
    "background": (0.4, 500, 1),
}

# Unit sizes.
EMU_PER_PX = 9525
EMU_PER_PT = 12700
PT_PER_PX = 0.75

# Line dash names.
DASHES = {
    "dashed": "dash", "dash": "dash", "dotted": "dot", "dot": "dot", "dashdot": "dashDot",
    "dashdotdot": "lgDashDotDot", "longdash": "lgDash", "longdashdot": "lgDashDot",
    "solid": "solid", "none": "solid",
}
# Line end names as (type, size).
ARROWS = {
    "classic": ("triangle", "med"), "block": ("triangle", "med"), "classicthin": ("triangle", "sm"),
    "blockthin": ("triangle", "sm"), "open": ("arrow", "med"), "openthin": ("arrow", "sm"),
    "oval": ("oval", "med"), "diamond": ("diamond", "med"), "diamondthin": ("diamond", "sm"),
    "cross": ("stealth", "med"), "crossthin": ("stealth", "sm"), "dash": ("triangle", "sm"),
    "dashthin": ("triangle", "sm"), "line": ("triangle", "sm"), "linethin": ("triangle", "sm"),
}


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, NULL when absent."""
    items = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*items), key)


def layer_level(element_type: Column) -> Column:
    t = F.lower(element_type)
    out = F.lit(5)
    for level, names in LAYERS.items():
        out = F.when(t.isin(names), F.lit(level)).otherwise(out)
    return out


def prompt_to_type(prompt: Column) -> Column:
    p = F.lower(prompt)
    return (
        F.when(p.contains("dashed"), "section_panel")
        .when(p.contains("rounded"), "rounded rectangle")
        .when(p.contains("container"), "container")
        .otherwise("rectangle")
    )


def region_class(laplacian: Column, std: Column, contrast: Column, edge: Column) -> Column:
    is_complex = (laplacian > 800) | (std > 55)
    bordered = (contrast > 25) & (edge > 0.03)
    return (
        F.when(is_complex & ~bordered, "image_only")
        .when(bordered & ~is_complex, "shape_only")
        .when(bordered & is_complex, "shape_with_content")
        .otherwise("image_fallback")
    )


def initial_font_size(width, height, rotation, is_latex, is_vertical, formula_ratio=0.6, text_offset=1.0) -> Column:
    r = F.abs(rotation)
    turned = ((r > 75) & (r < 105)) | ((r > 255) & (r < 285))
    vertical = is_vertical | (~is_latex & (height > width * 2.0))
    size = (
        F.when(vertical & turned, height - 0.5)
        .when(vertical, width - 0.5)
        .when(is_latex, height * formula_ratio)
        .otherwise(height - text_offset)
    )
    return F.greatest(size, F.lit(6.0))


def is_vertical_text(width, height, rotation, is_latex) -> Column:
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    return ~is_latex & ((h / w >= 2.0) | (F.abs(F.abs(rotation) - 90) < 15))


def dilate_radius(base, font_px, box_h, lo, hi, font_ref, ratio, mode: Column) -> Column:
    by_box = F.bround(base + box_h * ratio)
    by_font = F.bround(base * font_ref / font_px)
    has_box, has_font = F.coalesce(box_h > 0, F.lit(False)), F.coalesce(font_px > 0, F.lit(False))
    start = F.floor(base)
    raw = (
        F.when(mode == "bbox", F.when(has_box, by_box).otherwise(start))
        .when(
            mode == "max",
            F.greatest(start, F.when(has_box, by_box).otherwise(start), F.when(has_font, by_font).otherwise(start)),
        )
        .otherwise(F.when(has_font, by_font).otherwise(start))
    )
    return F.least(F.greatest(raw, lo), hi).cast("int")


def side_of(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Relative port (x, y) on the side a direction points to; the longer axis decides."""
    eps = 1e-6

    def end(d):
        return F.when(d > eps, 1.0).when(d < -eps, 0.0).otherwise(0.5)

    flat = F.abs(dx) >= F.abs(dy)
    return F.when(flat, end(dx)).otherwise(0.5), F.when(flat, 0.5).otherwise(end(dy))


# --- units and marks --------------------------------------------------------
def px_to_emu(px):
    return (px * EMU_PER_PX).cast("bigint")


def pt_to_emu(pt):
    return (pt * EMU_PER_PT).cast("bigint")


def px_to_pt(px):
    return px * PT_PER_PX


def pt_to_px(pt):
    return pt / PT_PER_PX


def emu_to_px(emu):
    return emu / EMU_PER_PX


def emu_to_pt(emu):
    return emu / EMU_PER_PT


def scaled_font_size(pt):
    return pt * PT_PER_PX


def marker_size(px: Column) -> Column:
    return F.when(px <= 6.5, "sm").when(px <= 10.5, "med").when(px.isNotNull(), "lg")


def dash_name(name: Column) -> Column:
    return lookup(F.lower(name), DASHES)


def arrow_type(name: Column) -> Column:
    return lookup(F.lower(name), {k: v[0] for k, v in ARROWS.items()})


def arrow_size(name: Column, px: Column) -> Column:
    base = lookup(F.lower(name), {k: v[1] for k, v in ARROWS.items()})
    return F.when(base.isNotNull(), F.coalesce(marker_size(px), base))


def arc_size(rounded: Column, width: Column, height: Column) -> Column:
    side = F.least(width, height)
    return F.when(
        rounded, F.when(side > 0, F.least(((side * 0.1 / side) * 100000).cast("bigint"), F.lit(100000))).otherwise(50000)
    )


def replaced_font(font: Column, replacements: dict[str, str]) -> Column:
    out = font
    if replacements:
        out = F.coalesce(lookup(font, replacements), font)
    return F.when(font != "", out)


def half_up(value: str | Column, digits: int) -> Column:
    """A double rounded as SQL does it: scaled, rounded half away from zero, scaled back.

    Spark's own ``round`` goes by the decimal text of the number, which differs by one last digit next to a half.
    """
    scale = 10.0**digits
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale
