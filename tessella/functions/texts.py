"""Text rules: fonts, formulas, refinement gate, escaping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessella.functions.paths import let

CJK = r"[\u4e00-\u9fff]"
DEFAULT_FONT = "Arial Narrow"

# Font names by exact or contained key, in matching order.
FONT_NAMES = {
    "microsoft yahei": "Microsoft YaHei", "微软雅黑": "Microsoft YaHei", "simhei": "SimHei", "黑体": "SimHei",
    "dengxian": "DengXian", "等线": "DengXian", "arial": "Arial Narrow", "calibri": "Calibri",
    "verdana": "Verdana", "helvetica": "Helvetica", "roboto": "Roboto", "comic sans": "Comic Sans MS",
    "comic sans ms": "Comic Sans MS", "simsun": "SimSun", "宋体": "SimSun", "times new roman": "Times New Roman",
    "times": "Times New Roman", "georgia": "Georgia", "yu mincho": "SimSun", "ms mincho": "SimSun",
    "courier new": "Courier New", "courier": "Courier New", "consolas": "Courier New", "monaco": "Courier New",
    "menlo": "Courier New",
}
# Font families by keyword.
SERIF = ["baskerville", "garamond", "palatino", "didot", "bodoni"]
SANS = ["segoe", "tahoma", "trebuchet", "lucida"]
MONO = ["mono", "consolas", "menlo", "monaco", "courier"]
# Marks of code and of academic prose.
CODE_MARKS = ["id_", "code_", "0x", "struct", "func_", "var_", "ptr_", "def ", "class ", "import ", "__", "::", "{}"]
ACADEMIC = ["figure", "table", "equation", "result", "method", "data", "analysis"]


def has_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def standard_font(name: Column) -> Column:
    """Exact key, else the first key contained in the name, else a family keyword, else the name."""
    table = F.create_map(*[F.lit(v) for kv in FONT_NAMES.items() for v in kv])
    keys = F.array(*[F.lit(k) for k in FONT_NAMES])

    def known(main):
        key = F.lower(main)
        part = F.get(F.filter(keys, lambda k: F.contains(key, k)), F.lit(0))
        family = F.when(has_any(key, SERIF), "Times New Roman").when(has_any(key, SANS), "Arial Narrow").when(has_any(key, MONO), "Courier New")
        return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, part), family, main)

    main = F.trim(F.substring_index(F.trim(name), ",", 1))
    return F.when(F.coalesce(name, F.lit("")) == "", DEFAULT_FONT).otherwise(let(main, known))


def is_code(text: Column) -> Column:
    one_word = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) == 1
    return has_any(F.lower(text), CODE_MARKS) | (text.contains("_") & one_word)


def is_academic(text: Column) -> Column:
    sentence = text.contains(" ") & (F.length(text) > 15) & (text.contains(".") | text.contains(",") | text.contains(";"))
    return (has_any(F.lower(text), ACADEMIC) & (F.length(text) > 10)) | sentence


def inferred_font(text: Column, is_latex: Column, default: Column) -> Column:
    return (
        F.when(is_latex, "Times New Roman")
        .when(text.rlike(CJK), "SimSun")
        .when(is_code(text), "Courier New")
        .when(is_academic(text), "Times New Roman")
        .otherwise(default)
    )


# --- N06 formulas -------------------------------------------------------------
# Marks of mathematics, marks of misread formulas, symbols expected inside arrays.
MATH_MARKS = [
    "\\frac", "\\sum", "\\int", "\\prod", "\\approx", "\\equiv", "\\neq", "\\leq", "\\geq", "\\mathbb", "\\mathbf",
    "\\pi", "\\theta", "\\sigma", "\\alpha", "\\beta", "\\gamma", "\\epsilon", "\\varepsilon", "\\delta", "\\lambda", "\\mu",
    "\\sqrt", "\\tilde", "\\hat", "\\bar", "\\vec", "\\dot", "_", "^", "=", "+", "-", "\\times", "\\cdot",
    "\\left", "\\right", "\\langle", "\\rangle",
]
MISREAD = [
    "\\Updownarrow", "\\dagger", "\\hat{\\varUpsilon}", "\\underline", "\\underbrace", "\\overbrace", "\\varPsi", "\\vdots",
    "\\Im", "\\widehat{\\left\\{",
]
ARRAY_SYMBOLS = ["_{", "^{", "=", "\\mathbf", "\\mathrm", "\\alpha", "\\beta", "\\tau", "\\kappa", "f_", "M_", "v_", "c_"]
# Command replacements, applied in this order.
LATEX_SWAPS = [
    ("\\boldsymbol", "\\mathbf"), ("\\cfrac", "\\frac"), ("\\ ", " "), ("\\mathrm{o l d}", "\\text{old}"), ("\\protect", ""),
    ("\\overset{\\circ}", ""), ("\\widehat{\\Gamma}", ""), ("\\circledR", "\\otimes"), ("\\copyright", "\\otimes"),
    ("\\textcircled{x}", "\\otimes"), ("\\textcircled{\\times}", "\\otimes"), ("\\textcircled{r}", "\\otimes"), ("\\textcircled{R}", "\\otimes"),
]


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def is_valid_formula(latex: Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(latex), r"^\$+|\$+$", ""))
    inner = F.regexp_extract(t, r"(?s)\\begin\{(array|matrix)\}[^}]*\}?(.*?)\\end\{\1\}", 2)
    boxed = t.rlike(r"(?s)\\begin\{(array|matrix)\}[^}]*\}?(.*?)\\end\{\1\}")
    hollow = boxed & ~has_any(inner, ARRAY_SYMBOLS) & (F.length(F.regexp_replace(inner, r"[\\{}\[\]\s|&]", "")) < 5)
    tail = F.substring(t, 9, 100)
    plain_bold = t.startswith("\\mathbf{") & (F.length(t) < 15) & ~t.contains("_{") & ~t.contains("^{") & ~tail.contains("_") & ~tail.contains("^")
    return (
        (F.length(t) >= 2) & has_any(t, MATH_MARKS) & ~has_any(t, MISREAD) & ~t.rlike(r"(.{2,10}?)\1{3,}") & ~hollow & ~plain_bold
        & (count_of(t, "{") == count_of(t, "}"))
    )


def clean_latex(latex: Column) -> Column:
    for old, new in LATEX_SWAPS:
        latex = F.replace(latex, F.lit(old), F.lit(new))
    return latex


# --- N08 refinement gate --------------------------------------------------------
# Suffixes read as subscripts.
SUFFIX = "(batch|max|min|avg|sum|total|mean|std|var|norm|dim)"
# Subscript hints in line text.
SUBSCRIPT_HINTS = [rf"[A-Z][a-z]?{SUFFIX}", r"[a-zA-Z]\d+", r"[a-zA-Z]{1,2}[a-z]{2,6}", r"\(\s*[sS][iI]\s*,", r"[A-Z]{2}\d"]
# Identifier shapes and expression shapes.
IDENTIFIERS = [
    r"^[A-Z][a-z]+([A-Z][a-z]+)+$", r"^[A-Z][a-z]+[A-Z][a-z]*\d*$", r"^[A-Z][a-z]*\d+[a-zA-Z][a-zA-Z\-]*$",
    r"^[a-zA-Z]+[_\-][a-zA-Z0-9_\-]+$", r"^[A-Z]{2,}\d*$",
]
EXPRESSIONS = [
    r"(?<![a-zA-Z])_(?![a-zA-Z])", r"\\", r"\d+/\d+", r"[a-zA-Z]\([a-zA-Z0-9,\s]+\)", r"\|\|", r"\(\d+[+\-][a-zA-Z]\)",
    r"[a-zA-Z]\d*\s*[\+\-\*]\s*[a-zA-Z]", r"^[\+\-][A-Za-z]", r"[A-Za-z]\.[A-Za-z]",
]


def any_pattern(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def subscript_hint(text: Column) -> Column:
    return F.coalesce(any_pattern(text, SUBSCRIPT_HINTS), F.lit(False))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def should_refine(text: Column, tall: Column, size_varies: Column) -> Column:
    """Ordered rules, the first that matches decides; nothing matching means no."""
    sql_like = (
        text.rlike(r"(?i)(?U)\b(WHERE|AND|OR)\b.*\b(WHERE|AND|OR|IN)\b")
        | text.rlike(r"(?U)[A-Z]\.[a-z_][\w\-]*\s*[><=!]")
        | text.rlike(r"(?i)(?U)\w+\s+IN\s+\[")
    )
    snake = text.rlike(r"(?i)^[a-z][a-z0-9]*(_[a-z0-9]+)+$") & (F.length(text) <= 20)
    plain = text.rlike(r"""^[a-zA-Z\s\-,.:;!?'"…]+$""") & (F.length(text) >= 5)
    cjk = F.size(F.regexp_extract_all(text, F.lit(f"({CJK})"), 1))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", False)
        .when(sql_like | snake | tall, False)
        .when(text.rlike(r"^\([A-Z][a-z]+(?:\s+[A-Za-z]+){2,}.*\)$") | plain, False)
        .when(size_varies & text.rlike(r"[=+\-*/^_(){}\[\]]|[a-zA-Z]\d|\d[a-zA-Z]"), True)
        .when(text.rlike("[?？]"), True)
        .when((word_count(text) > 10) & ~text.contains("="), False)
        .when(text.rlike(r"^\(?[\d,]+\s*[×xX]\s*[\d,]+\)?$"), False)
        .when(text.rlike("[α-ωΑ-Ω\\^≈≠≤≥∑∏∫√·×÷±∈∉⊂⊃∪∩€~]"), True)
        .when(text.contains("=") & ~text.rlike(r"^[a-z]=[0-9]$"), True)
        .when(any_pattern(text, IDENTIFIERS), False)
        .when(text.rlike(r"^[a-zA-Z][0-9]{1,2}$") | text.rlike(rf"(?i)^[A-Z][a-z]?{SUFFIX}$"), True)
        .when(cjk > F.length(text) * 0.3, False)
        .when(any_pattern(text, EXPRESSIONS), True)
        .when(text.rlike(r"^[A-Za-z]+\d+$") & (F.length(text) <= 4), True)
        .when(text.contains("(") & text.contains(")") & (F.length(text) <= 30), True)
        .otherwise(False)
    )


# What makes the tail of a mixed line a formula.
FORMULA_TAIL = [r"[A-Z][a-z]?\d", r"[A-Z][a-z]?(batch|max|min)", r"=\s*\(", r"[A-Z]{2}\d", r"\([A-Za-z][a-z]?i\)"]


def split_formula(text: Column) -> Column:
    """struct(has_both, text, formula): words in front of a formula-like tail."""
    pattern = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,})\s+(.*?)$"
    head, tail = F.trim(F.regexp_extract(text, pattern, 1)), F.trim(F.regexp_extract(text, pattern, 2))
    both = text.rlike(pattern) & any_pattern(tail, FORMULA_TAIL)
    listed = text.rlike(r"^\(([A-Z][a-z]+(?:\s+[A-Za-z]+)+)\s+([A-Z]\d+(?:\s+to\s+[A-Z][a-z])?)\)$")
    return F.struct(
        both.alias("has_both"), F.when(both, head).when(listed, text).otherwise("").alias("text"),
        F.when(both, tail).when(listed, "").otherwise(text).alias("formula"),
    )


def subscript_fallback(text: Column) -> Column:
    return F.regexp_replace(text, r"\(([A-Za-z])i\)", r"($1_{i})")


# --- N16 ---------------------------------------------------------------------------
# Patterns of misread CJK, of split function names and of unusable commands.
GARBAGE = [r"\\mathbb\{[A-Z]\}\s*\\frac", r"\\Re\\frac", r"\\pm1\s*\\pm", r"\\bot\\bot", r"\\overrightarrow\{1\s*0\}", r"\\Xi\}\s*\{5\}"]
SPLIT_NAMES = [r"(?i)e\s+x\s+p", r"(?i)l\s+o\s+g", r"(?i)s\s+i\s+n", r"(?i)c\s+o\s+s", r"(?i)l\s+n\s*\("]
UNUSABLE = [r"\\break", r"\\linebreak", r"\\\s+/", r"/\s*/"]
# Words of mathematics, words of description, commands of mathematics.
MATH_WORDS = ["exp", "log", "sin", "cos", "tan", "ln", "logit", "softmax", "attn", "mlp"]
PLAIN_WORDS = [
    "transform", "expected", "score", "proportion", "weights", "link", "from", "curvature", "features", "inputs", "outputs",
    "noise", "maturity", "signal", "rows", "clean", "invalid", "daily", "volume", "word", "vector", "linguistic", "feature",
    "failure", "probability", "confusion", "matrix", "optional", "attention", "representation", "standardize", "normalize",
    "full", "private", "public", "key", "secret", "node", "sender", "receiver", "client", "server", "batch", "verification",
]
MATH_COMMANDS = [
    "\\frac", "\\sqrt", "\\sum", "\\prod", "\\int", "\\alpha", "\\beta", "\\gamma", "\\delta", "\\theta", "\\sigma", "\\lambda",
    "\\mu", "\\pi", "\\epsilon", "\\varepsilon", "\\partial", "\\nabla", "\\infty", "\\times", "\\cdot", "\\div", "\\leq", "\\geq",
    "\\neq", "\\approx", "\\equiv", "\\left", "\\right", "\\langle", "\\rangle", "\\mathbb", "\\mathcal", "\\ln", "\\log", "\\exp",
    "\\sin", "\\cos", "\\to", "\\rightarrow", "\\leftarrow", "\\sim",
]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def refinement_ok(original: Column, latex: Column) -> Column:
    """Accept a refined text only when it is a real formula that keeps what the line said."""
    cjk_in = F.size(_all(original, CJK))
    lost = (cjk_in >= 2) & (F.size(_all(latex, CJK)) == 0)
    garbage = (cjk_in > 0) & any_pattern(latex, GARBAGE)
    bare = F.regexp_replace(F.regexp_replace(latex, r"[_^]\{[^}]+\}", ""), r"[_^][a-zA-Z0-9]", "")
    torn = F.size(_all(bare, r"[a-zA-Z]\s+[a-zA-Z]\s+[a-zA-Z]\s+[a-zA-Z]\s+[a-zA-Z]")) >= 2
    letters = F.lower(F.regexp_replace(F.regexp_replace(latex, r"\\[a-zA-Z]+", ""), r"[^a-zA-Z]", ""))
    words = _all(original, "[a-zA-Z]{3,}")

    def survives(w):
        lw = F.lower(w)
        found = F.size(F.filter(F.split(lw, ""), lambda ch: (ch != "") & F.contains(letters, ch)))
        return F.contains(letters, lw) | ((F.length(w) <= 3) & (found >= F.length(w) * 0.5))

    unread = (F.size(words) >= 2) & ~F.exists(words, survives)
    spaced = latex.rlike(r"\\math(sf|bf|rm|it)\{[a-zA-Z]([\s~]+[a-zA-Z]){3,}")
    prose = F.exists(_all(original, "[a-zA-Z]{4,}"), lambda w: F.lower(w).isin(PLAIN_WORDS) & ~F.lower(w).isin(MATH_WORDS))
    squeezed = F.regexp_replace(original, r"\s", "")
    core = F.regexp_replace(latex, r"\\(mathbf|mathrm|mathsf|textit|text|boldsymbol|mathcal|mathscr)\{([^}]+)\}", "$2")
    core = F.replace(F.regexp_replace(core, r"\s|~", ""), F.lit("$"), F.lit(""))
    real = has_any(latex, MATH_COMMANDS) | latex.rlike(r"_\{[0-9a-z]\}|_[0-9]|\^\{[0-9a-zT]\}|\^[0-9T]")
    stripped = F.regexp_replace(F.regexp_replace(F.replace(latex, F.lit("$"), F.lit("")), r"\s", ""), r"\\[a-zA-Z]+\{|\}", "")
    bad = lost | garbage | any_pattern(latex, SPLIT_NAMES) | any_pattern(latex, UNUSABLE) | torn | unread | (spaced & prose)
    return ~(bad | (core == squeezed) | ~real | (F.lower(squeezed) == F.lower(stripped)))


# --- N07 -----------------------------------------------------------------------------
def comparable(text: Column) -> Column:
    """Lower case without blanks, brackets and formula commands."""
    t = F.regexp_replace(F.lower(text), r"[\s$\\{}\[\]]", "")
    # A run of letters that has no bf after its first letter has none after a later one: it is looked through once, not from each letter.
    return F.regexp_replace(t, r"(?<![a-z])[a-z]+bf|mathbf|frac|theta|pi|approx|sum|mathbb", "")


# --- N09 / N11 / N15 -------------------------------------------------------------------
def _swap(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_xml(text: Column, apostrophe: str = "&apos;") -> Column:
    return _swap(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)])


def escape_text(text: Column, is_latex: Column) -> Column:
    """Escaped markup with formulas in \\( \\) brackets."""
    e = escape_xml(text, "&#x27;")
    whole = F.concat(F.lit("\\("), F.trim(F.replace(e, F.lit("$"), F.lit(""))), F.lit("\\)"))
    return F.when(is_latex, whole).otherwise(F.regexp_replace(e, r"\$([^$]+)\$", r"\\($1\\)"))


def plain_text(markup: Column) -> Column:
    """Text of a rich label: breaks become newlines, tags go, entities are read."""
    t = F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return _swap(t, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")])


def text_cell(cell_id: Column, text: Column, x, y, w, h, font_size: Column, color: Column) -> Column:
    """A text cell as markup."""
    style = F.concat(F.lit("text;html=1;whiteSpace=wrap;fontSize="), font_size.cast("string"), F.lit(";fontColor="), color, F.lit(";"))
    n = lambda v: v.cast("bigint").cast("string")
    return F.concat(
        F.lit('<mxCell id="'), cell_id, F.lit('" parent="1" vertex="1" value="'), escape_xml(text), F.lit('" style="'), style,
        F.lit('"><mxGeometry x="'), n(x), F.lit('" y="'), n(y), F.lit('" width="'), n(w), F.lit('" height="'), n(h), F.lit('" as="geometry"/></mxCell>'),
    )
