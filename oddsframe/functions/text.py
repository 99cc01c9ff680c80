"""Text column helpers: numbers in text, name normalisation, HTML text, name similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from oddsframe import dims

_CJK = "\\u4e00-\\u9fff"
# Blocks with compatibility forms: Latin to symbols, enclosed and square CJK, CJK compatibility, ligatures, full width,
# and beyond the first plane mathematical letters, enclosed letters and CJK compatibility.
_RANGES = ((0x80, 0x3400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x10780, 0x107C0), (0x11080, 0x110B0), (0x1CCD6, 0x1CCFA), (0x1D400, 0x1D800), (0x1E030, 0x1E070), (0x1EE00, 0x1EF00), (0x1F100, 0x1F260), (0x1FBF0, 0x1FBFA), (0x2F800, 0x2FA20))


@lru_cache(maxsize=None)
def _compatible(marks: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters and the one character each stands for, and those that stand for several, by Unicode rules.

    With `marks`, compatibility forms only (NFKC); without, letters lose their marks as well (NFKD).  Hangul syllables
    are left whole, and their parts are not joined.
    """
    single, several, lost = {}, {}, []
    for c in (chr(n) for a, b in _RANGES for n in range(a, b) if not 0xD800 <= n < 0xE000):
        plain = unicodedata.normalize("NFKC" if marks else "NFKD", c)
        if not marks:
            plain = "".join(x for x in plain if unicodedata.category(x) != "Mn").lower()
        known = c.isalnum() or c == "\u3000" or unicodedata.category(c) == "Mn"
        if not plain:
            lost.append(c)
        elif plain != c and (known or any(x.isalnum() or x in "()" for x in plain)):
            (single if len(plain) == 1 else several)[c] = plain
    return "".join([*single, *lost]), "".join(single.values()), tuple(several.items())  # the last have no counterpart: they go


@lru_cache(maxsize=None)
def _composed() -> tuple[tuple[str, str], ...]:
    """A letter with a mark behind it, and the one character of both; those that more marks build on come first."""
    pairs = {}
    for n in range(0xC0, 0x3100):
        parts = unicodedata.normalize("NFD", chr(n))
        base = unicodedata.normalize("NFC", parts[:-1])
        if len(parts) > 1 and len(base) == 1 and unicodedata.normalize("NFC", parts) == chr(n):
            pairs[base + parts[-1]] = chr(n)
    return tuple(sorted(pairs.items(), key=lambda p: len(unicodedata.normalize("NFD", p[1]))))


def _any_of(chars) -> str:
    """Pattern for one of the characters, neighbours as ranges: a long list is compared one by one."""
    points, runs = sorted({ord(c) for c in chars}), []
    for n in points:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def _replaced(col: Column, pairs: tuple[tuple[str, str], ...], where: Column) -> Column:
    """The pairs replaced one after the other, in the few rows that hold any."""
    known = _texts(a + "\x1e" + b for a, b in pairs)
    spelled = F.aggregate(known, col, lambda t, p: F.replace(t, F.substring_index(p, "\x1e", 1), F.substring_index(p, "\x1e", -1)))
    return F.when(where, spelled).otherwise(col)


def _folded(col: Column, marks: bool) -> Column:
    """Compatibility forms replaced, and with `marks` letters joined with their marks; plain ASCII is left alone."""
    old, new, several = _compatible(marks)
    folded = F.translate(_replaced(col, several, col.rlike(_any_of(a for a, _ in several))), old, new)
    if marks:
        behind = _any_of(pair[-1] for pair, _ in _composed())
        folded = let(folded, lambda t: _replaced(t, _composed(), t.rlike(behind)))
    return F.when(col.rlike("[^\\x00-\\x7F]"), folded).otherwise(col)


def text(col) -> Column:
    """The column as text with missing as ''."""
    return F.coalesce(col.cast("string") if isinstance(col, Column) else F.col(col).cast("string"), F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def first_number(col: Column) -> Column:
    """First signed decimal in the text, thousands commas ignored; NULL if there is none."""
    found = F.regexp_extract(F.regexp_replace(col.cast("string"), ",", ""), r"-?\d+(?:\.\d+)?", 0)
    return found.try_cast("double")


def to_traditional(col: Column) -> Column:
    for old, new in dims.TRADITIONAL_PHRASES:
        col = F.replace(col, F.lit(old), F.lit(new))
    return F.translate(col, *dims.TRADITIONAL_CHARS)


def _drop_rest(col: Column) -> Column:
    return F.regexp_replace(col, f"[^0-9a-z{_CJK}]+", "")


def norm_name(col: Column) -> Column:
    """Comparable league / bookmaker name."""
    out = F.replace(F.lower(to_traditional(text(col))), F.lit("封"), F.lit(""))
    return _drop_rest(F.regexp_replace(out, "[（(][^）)]*[）)]", ""))


def fold_text(col: Column) -> Column:
    """Compatibility forms (width, ligatures, Roman numerals, ...), case and script fold."""
    return F.translate(F.lower(_folded(text(col), marks=True)), *dims.FOLD_CHARS)


def _drop_brackets(col: Column) -> Column:
    return F.regexp_replace(col, r"\([^)]*\)|（[^）]*）", "")


def norm_team(col: Column) -> Column:
    """Comparable team name: folded, without brackets, club tokens and club words."""
    tokens, suffixes = "|".join(dims.CLUB_TOKENS), "|".join(dims.CLUB_SUFFIXES)
    out = _drop_brackets(fold_text(col))
    out = F.regexp_replace(out, f"^(?:{'|'.join(dims.CLUB_PREFIXES)})(?=[{_CJK}])", "")
    # ASCII word borders: Java's \b also counts CJK characters as word characters.
    out = F.regexp_replace(out, f"(?<![0-9A-Za-z_])(?:{tokens})(?![0-9A-Za-z_])", "")
    out = F.regexp_replace(out, f"([{_CJK}])(?:{suffixes})$", "$1")
    out = F.regexp_replace(out, "|".join(dims.CLUB_WORDS), "")
    return _drop_rest(out)


def norm_comp(col: Column) -> Column:
    """Comparable competition name."""
    return _drop_rest(_drop_brackets(fold_text(col)))


def _plain_letters(col: Column) -> Column:
    return F.regexp_replace(_folded(F.lower(text(col)), marks=False), "\\p{Mn}+", "")


def norm_latin(col: Column) -> Column:
    """Letters and digits only, marks removed, lower case."""
    return F.regexp_replace(_plain_letters(col), r"[^\p{L}\p{N}]+", "")


def tokens3(col: Column) -> Column:
    """Distinct words of three or more letters."""
    words = F.split(_plain_letters(col), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def _codes(name: Column) -> Column:
    """Code points of a text."""
    return F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def chars(name: Column) -> Column:
    """Distinct characters, as code points: whole numbers compare much faster than texts."""
    return F.array_distinct(_codes(name))


def bigrams(name: Column) -> Column:
    """Distinct character pairs of an already normalised name (characters if two or fewer)."""
    def pairs(codes):
        both = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: a * F.lit(2097152) + b)
        return F.when(F.size(codes) <= 2, codes).otherwise(F.filter(both, lambda p: p.isNotNull()))

    return F.array_distinct(F.transform(F.array(_codes(name)), pairs)[0])


def dice(left: Column, right: Column) -> Column:
    """2 * shared / (n + m) of two distinct arrays; 0 if either is empty."""
    total = F.size(left) + F.size(right)
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(left, right)) / total)


def edit_sim(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    empty = (left == "") | (right == "")
    return F.when(empty, F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(left, right) / longest)


@lru_cache(maxsize=None)
def normed(norm, names: tuple[str, ...]) -> tuple[str, ...]:
    """A fixed name list put through a normaliser (a local relation: no job runs)."""
    rows = SparkSession.active().createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    return tuple(r.n for r in sorted(rows.select("i", norm(F.col("name")).alias("n")).collect()))


def _normed_groups(norm, groups: list[list[str]]) -> dict[str, int]:
    """Normalised alias -> index of its (first) group, in group order."""
    flat = normed(norm, tuple(a for g in groups for a in g))
    index = [i for i, g in enumerate(groups) for _ in g]
    out: dict[str, int] = {}
    for name, i in zip(flat, index):
        if name:
            out.setdefault(name, i)
    return out


def _texts(values) -> Column:
    """A constant text array, sent as one literal and folded by the optimizer."""
    return F.split(F.lit("\x1f".join(str(v) for v in values)), "\x1f")


def team_group(name: Column) -> Column:
    """Index of the alias group that holds the name."""
    groups = _normed_groups(norm_team, dims.TEAM_ALIASES)
    at = F.array_position(_texts(groups), name)
    return F.when(at > 0, F.element_at(_texts(groups.values()), at.cast("int")).cast("int"))


def comp_group(name: Column) -> Column:
    """Index of the first competition group with a name that holds, or is held by, this one."""
    groups = _normed_groups(norm_comp, dims.COMPETITION_ALIASES)
    close = F.transform(_texts(groups), lambda a: F.contains(name, a) | F.contains(a, name))
    at = F.array_position(close, F.lit(True))
    return F.when((name != "") & (at > 0), F.element_at(_texts(groups.values()), at.cast("int")).cast("int"))


def _keys(norms: Column) -> Column:
    """Comparison structs of normalised names; lambdas keep each name a variable, not a copied tree."""
    def key(norm):
        grams = F.transform(F.array(norm_team(norm)), bigrams)[0]
        return F.struct(norm.alias("n"), grams.alias("g"), chars(norm).alias("c"), team_group(norm).alias("grp"))

    return F.transform(norms, key)


def name_key(col: Column) -> Column:
    """Everything name comparison needs, worked out once per name before any pairing."""
    return _keys(F.array(norm_team(col)))[0]


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two `name_key` structs, cheap tests first."""
    la, lb = F.length(a["n"]), F.length(b["n"])
    ratio = F.least(la, lb) / F.greatest(la, lb)
    contained = F.contains(a["n"], b["n"]) | F.contains(b["n"], a["n"])
    fuzzy = F.greatest(
        dice(a["g"], b["g"]), dice(a["c"], b["c"]) * F.lit(0.96), edit_sim(a["n"], b["n"]) * F.lit(0.92)
    )
    return (
        F.when((a["n"] == "") | (b["n"] == ""), F.lit(0.0))
        .when(a["n"] == b["n"], F.lit(1.0))
        .when(a["grp"] == b["grp"], F.lit(1.0))
        .when(contained, F.greatest(F.lit(0.82), F.least(F.lit(0.96), ratio + F.lit(0.18))))
        .otherwise(fuzzy)
    )


def best_side_similarity(lefts: Column, rights: Column) -> Column:
    """Best similarity over two arrays of name variants."""
    def against(best, left):
        return F.aggregate(rights, best, lambda acc, right: F.greatest(acc, name_similarity(left, right)))

    return F.aggregate(lefts, F.lit(0.0), lambda acc, left: F.when(acc >= 1.0, acc).otherwise(against(acc, left)))


def name_variants(*cols: Column) -> Column:
    """Distinct non-empty `name_key`s of up to ten spellings."""
    norms = F.transform(F.array(*[text(c) for c in cols]), norm_team)
    return _keys(F.array_distinct(F.filter(norms, lambda n: n != "")))


def fixture_name_key(col: Column) -> Column:
    return F.struct(norm_latin(col).alias("n"), tokens3(col).alias("t"))


def fixture_name_score(a: Column, b: Column) -> Column:
    """1 if equal, 0.82 if contained, else shared words / larger word count."""
    contained = F.contains(a["n"], b["n"]) | F.contains(b["n"], a["n"])
    none = (F.size(a["t"]) == 0) | (F.size(b["t"]) == 0)
    shared = F.size(F.array_intersect(a["t"], b["t"])) / F.greatest(F.size(a["t"]), F.size(b["t"]))
    return (
        F.when((a["n"] == "") | (b["n"] == ""), F.lit(0.0))
        .when(a["n"] == b["n"], F.lit(1.0))
        .when(contained, F.lit(0.82))
        .when(none, F.lit(0.0))
        .otherwise(shared)
    )


def let(value: Column, fn) -> Column:
    """fn(value) with the value worked out once; long text chains would else repeat it."""
    return F.transform(F.array(value), fn)[0]


def strip_tags(col: Column) -> Column:
    def strip(t):
        out = F.regexp_replace(t, r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
        out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
        return F.regexp_replace(out, r"<[^>]+>", "")

    return let(col, lambda t: F.when(F.contains(t, F.lit("<")), strip(t)).otherwise(t))


# Named entities in the order they are decoded.
_ENTITIES = [("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")]


def _named_entities(col: Column) -> Column:
    for name, char in _ENTITIES:
        col = F.regexp_replace(col, f"(?i)&{name};", char)
    return col


def decode_entities(col: Column) -> Column:
    """Named entities, then hex and decimal numeric ones."""
    def numeric(t):
        hexed = let(t, lambda x: _numeric_entities(x, "(?i)&#x([0-9a-f]+);", 16))
        decoded = let(hexed, lambda x: _numeric_entities(x, "&#([0-9]+);", 10))
        return F.when(F.contains(t, F.lit("&#")), decoded).otherwise(t)

    return let(col, lambda t: F.when(F.contains(t, F.lit("&")), let(_named_entities(t), numeric)).otherwise(t))


def _numeric_entities(col: Column, pattern: str, base: int) -> Column:
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)))
    lead = "&#x" if base == 16 else "&#"

    def swap(acc, digits):
        code = F.conv(digits, base, 10).cast("int")
        # chr() stops at 255, so the code point goes through its UTF-32 bytes.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.replace(acc, F.concat(F.lit(lead), digits, F.lit(";")), char)
        return F.replace(out, F.concat(F.lit("&#X"), digits, F.lit(";")), char) if base == 16 else out

    return F.aggregate(found, col, swap)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[\s ]+", " "))


def cell_text(col: Column) -> Column:
    """Visible text of an HTML fragment."""
    return squeeze(decode_entities(strip_tags(text(col))))


def match_text(col: Column) -> Column:
    """Cell text with the neutral-ground mark in one form."""
    mark = lambda t: squeeze(F.regexp_replace(t, r"(?i)\s*\((?:中|neutral)\)\s*", "(中)"))
    return let(cell_text(col), lambda t: F.when(F.contains(t, F.lit("(")), mark(t)).otherwise(t))


def block_text(col: Column) -> Column:
    """Text of a crowd page fragment: every tag becomes a space."""
    def plain(t):
        out = F.regexp_replace(t, r"(?is)<script.*?</script>|<style.*?</style>", "")
        return squeeze(_named_entities(F.regexp_replace(out, r"<[^>]+>", " ")))

    return let(text(col), lambda t: F.when(t.rlike("[<&]"), plain(t)).otherwise(squeeze(t)))


def absolute_url(url: Column, base: str) -> Column:
    """Absolute form of a link found on the page `base`."""
    scheme, rest = base.split("://", 1)
    host = f"{scheme}://{rest.split('/', 1)[0]}"
    folder = base.rsplit("/", 1)[0] if "/" in rest else base
    return (
        F.when(text(url) == "", F.lit(""))
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("/"), F.concat(F.lit(host), url))
        .otherwise(F.concat(F.lit(folder + "/"), url))
    )


def mask_key(url: Column, key: str = "key") -> Column:
    """Hide the value of the secret query parameter."""
    return F.regexp_replace(url, f"([?&]){key}=[^&#]*", f"$1{key}=sk-***")


def token_estimate(col: Column) -> Column:
    return F.ceil(F.length(text(col)) / 4).cast("long")
