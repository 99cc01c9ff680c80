"""Odds tables and page headers in HTML.

A page's rows and cells are handled as arrays inside the page's row, so parsing needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.functions.rows import spread
from oddsframe.functions.text import cell_text, decode_entities, let, match_text, text


def _kept(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "body"]


def _find_all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def table_html(body: Column, table_id: str) -> Column:
    """The table with this id up to its end tag, '' if absent."""
    return F.regexp_extract(
        body, rf"(?s)(?i:<table\b[^>]*\bid\s*=\s*[\"']?{table_id}[\"']?[^>]*>).*?(?:</table>|\z)", 0
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, '' if absent."""
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>`]+)", 1)
    return let(quoted, lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def _tag_end(outer: Column) -> Column:
    """Where the start tag of an element ends; its pattern has found one."""
    return F.locate(">", outer)


def _attr(tag: Column, name: str) -> Column:
    """Decoded attribute, looked for only where the tag holds its name."""
    here = F.contains(F.lower(tag), F.lit(name))
    return F.when(here, decode_entities(attribute(tag, name))).otherwise(F.lit(""))


def _cell(outer: Column) -> Column:
    """What rows are chosen by; texts and price attributes are read from the cells that are used."""
    end = _tag_end(outer)
    inner = F.substring(outer, end + 1, F.length(outer) - end - len("</td>"))
    parts = F.struct(F.substring(outer, F.lit(1), end).alias("tag"), inner.alias("html"))
    return let(parts, lambda p: F.struct(_attr(p["tag"], "colspan").alias("colspan"), _attr(p["tag"], "oddstype").alias("oddstype"), p["tag"], p["html"]))


def _price_cell(c: Column) -> Column:
    return F.struct(cell_text(c["html"]).alias("text"), _attr(c["tag"], "goals").alias("goals"), _attr(c["tag"], "title").alias("title"))


_CELLS = r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>"


def _row(outer: Column) -> Column:
    def head(tag):
        hidden = attribute(tag, "style").rlike(r"(?i)display\s*:\s*none") | attribute(tag, "class").rlike("(?i)blue_txt")
        return F.struct(hidden.alias("hidden"), attribute(tag, "companyid").alias("company"))

    end = _tag_end(outer)
    cells = F.transform(_find_all(F.substring(outer, end + 1, F.length(outer)), _CELLS), _cell)
    parts = F.struct(cells.alias("cells"), let(F.substring(outer, F.lit(1), end), head).alias("head"))
    return let(
        parts,
        lambda p: F.struct(p["cells"], p["head"]["hidden"].alias("hidden"), p["head"]["company"].alias("row_company")),
    )


def html_rows(table: Column) -> Column:
    return F.transform(_find_all(table, r"(?is)<tr\b[^>]*>.*?</tr>"), _row)


def flat_rows(table: Column) -> Column:
    """Rows of a table without row tags: a row starts at a cell with the odds check box."""
    cells = F.transform(_find_all(table, _CELLS), _cell)
    start = r"(?i)\bname\s*=\s*[\"']?oddsShow\b|\bdata-id\s*=\s*[\"']?\d+"

    def cut(cs):
        at = F.filter(
            F.transform(cs, lambda c, i: F.when(c["html"].rlike(start), i + 1)), lambda i: i.isNotNull()
        )
        until = lambda k: F.coalesce(F.get(at, k + 1), F.size(cs) + 1)
        return F.transform(at, lambda s, k: F.slice(cs, s, until(k) - s))

    groups = let(cells, cut)
    as_row = lambda g: F.struct(g.alias("cells"), F.lit(False).alias("hidden"), F.lit("").alias("row_company"))
    return F.transform(F.filter(groups, lambda g: F.size(g) >= 6), as_row)


def _triplet(cells: Column) -> Column:
    """Price, line and price of the first three of some cells."""
    return let(F.transform(F.slice(cells, 1, 3), _price_cell), _triplet_of)


def _triplet_of(cells: Column) -> Column:
    a, line, b = (F.get(cells, F.lit(i)) for i in range(3))
    title = lambda c: F.nullif(c["title"], F.lit(""))
    return F.struct(
        text(a["text"]).alias("a"), text(line["text"]).alias("line"), text(b["text"]).alias("b"),
        text(line["goals"]).alias("line_value"), F.coalesce(title(line), title(a), title(b), F.lit("")).alias("time"),
    )


def _quote(row: Column) -> Column:
    """Quote of a row; each group of price cells is picked once."""
    kind = lambda name: F.filter(row["cells"], lambda c: F.lower(c["oddstype"]) == name)
    marked = F.struct(kind("wholeodds").alias("whole"), kind("wholelastodds").alias("last"))
    return let(marked, lambda m: _quote_of(row, row["cells"], m["whole"], m["last"]))


def _quote_of(row: Column, cells: Column, whole: Column, last: Column) -> Column:
    return let(cell_text(cells[1]["html"]), lambda name: _named_quote(row, cells, whole, last, name))


def _named_quote(row: Column, cells: Column, whole: Column, last: Column, name: Column) -> Column:
    return F.struct(
        F.coalesce(
            F.nullif(F.regexp_extract(cells[0]["html"], r"(?i)\bdata-id\s*=\s*[\"']?(\d+)", 1), F.lit("")), row["row_company"]
        ).alias("company_id"),
        F.trim(F.regexp_replace(F.replace(name, F.lit("封"), F.lit("")), r"\s+", " ")).alias("company"),
        F.contains(name, F.lit("封")).alias("is_closed"),
        row["hidden"].alias("hidden"),
        cell_text(cells[2]["html"]).alias("multi_label"),
        let(F.slice(cells, 4, 3), _triplet).alias("initial"),
        let(F.when(F.size(whole) >= 3, whole).otherwise(F.slice(cells, 10, 3)), _triplet).alias("current"),
        F.when(F.size(last) >= 3, _triplet(last)).alias("last_before_current"),
    )


def _with_company(quotes: Column) -> Column:
    """Hidden rows take the company of the last visible row above them.

    The rows are cut at the visible ones, so every row is looked at once.
    """
    def fill(q, seen):
        lacks = q["hidden"] | (q["company"] == "") | (q["company_id"] == "")
        return let(F.when(lacks, seen), lambda above: filled(q, above))

    def filled(q, seen):
        pick = lambda n: F.coalesce(F.nullif(q[n], F.lit("")), seen[n], F.lit(""))
        return F.struct(
            pick("company_id").alias("company_id"), pick("company").alias("company"), q["is_closed"].alias("is_closed"),
            q["hidden"].alias("is_multi_line"), q["multi_label"].alias("multi_label"), q["initial"].alias("initial"),
            q["current"].alias("current"), q["last_before_current"].alias("last_before_current"),
        )

    visible = lambda q: ~q["hidden"] & (q["company"] != "")
    heads = F.filter(F.transform(quotes, lambda q, i: F.when(visible(q) | (i == 0), i)), lambda i: i.isNotNull())

    def cut(starts):
        def part(s, k):
            rows = F.slice(quotes, s + 1, F.coalesce(F.get(starts, k + 1), F.size(quotes)) - s)
            head = F.when(visible(quotes[s]), quotes[s])
            return let(head, lambda seen: F.transform(rows, lambda q: fill(q, seen)))

        return F.flatten(F.transform(starts, part))

    return F.filter(let(heads, cut), lambda q: q["company"] != "")


def parse_odds_table(df: DataFrame, include_multi: bool = False) -> DataFrame:
    """Two-way quotes of the `odds` table, with or without its hidden rows."""
    def quotes(table):
        rows = F.when(table.rlike(r"(?is)<tr\b[^>]*>.*?</tr>"), html_rows(table)).otherwise(flat_rows(table))
        full = F.filter(
            rows, lambda r: (F.size(r["cells"]) >= 12) & ~F.exists(r["cells"], lambda c: c["colspan"] != "")
        )
        shown = full if include_multi else F.filter(full, lambda r: ~r["hidden"])
        return let(F.transform(shown, _quote), _with_company)

    rows = spread(df, _kept(df), let(table_html(F.col("body"), "odds"), quotes), "_r")
    return rows.select(*_kept(df), "pos", "_r.*")


def parse_flat_odds_table(df: DataFrame) -> DataFrame:
    """The same for captures whose table lost its row tags."""
    return parse_odds_table(df.withColumn("body", F.regexp_replace("body", r"(?i)</?tr\b[^>]*>", "")))


_EUROPE_CELLS = [
    "company", "win", "draw", "loss", "win_rate", "draw_rate", "loss_rate", "return_rate", "kelly_win", "kelly_draw",
    "kelly_loss", "changed_at_raw",
]


def parse_europe_html(df: DataFrame) -> DataFrame:
    """Three-way odds from the first of the known tables, else from the whole page."""
    body = F.col("body")
    source = F.coalesce(*[F.nullif(table_html(body, i), F.lit("")) for i in ("odds", "datatb", "data")], body)
    texts = F.transform(
        html_rows(source), lambda r: F.filter(F.transform(r["cells"], lambda c: cell_text(c["html"])), lambda t: t != "")
    )
    header = "公司|所有|主胜|主勝|凱利|凯利|返还|返還"
    rows = F.filter(texts, lambda t: (F.size(t) >= 10) & ~t[0].rlike(header))
    out = spread(df, _kept(df), rows, "_t")
    cells = [text(F.get(F.col("_t"), F.lit(i))).alias(n) for i, n in enumerate(_EUROPE_CELLS)]
    return out.select(*_kept(df), "pos", F.lit("europe").alias("market"), F.lit("full").alias("period"), *cells)


def _last_link(body: Column, css: str) -> Column:
    block = F.regexp_extract(body, rf"(?is)<div\b[^>]*class=[\"'][^\"']*\b{css}\b[^\"']*[\"'][^>]*>(.*?)</div>", 1)
    links = F.regexp_extract_all(block, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    names = F.filter(F.transform(links, match_text), lambda n: n != "")
    return F.try_element_at(names, F.lit(-1))


def parse_page_meta(df: DataFrame) -> DataFrame:
    """League, kickoff and teams of a page header, desktop first, mobile as fallback."""
    body = F.col("body")
    by_id = lambda i: match_text(F.regexp_extract(body, rf"(?is)<div\b[^>]*id=[\"']{i}[\"'][^>]*>(.*?)</div>", 1))
    league = F.regexp_extract(body, r"(?is)<a\b[^>]*class=[\"'][^\"']*\bLName\b[^\"']*[\"'][^>]*>(.*?)</a>", 1)
    time = F.regexp_extract(body, r"(?is)<span\b[^>]*class=[\"'][^\"']*\btime\b[^\"']*[\"'][^>]*>(.*?)</span>", 1)
    kickoff = F.trim(F.regexp_replace(match_text(time), r"\s*星期.*", ""))
    mobile = F.regexp_extract(body, r"(?is)<div\b[^>]*class=[\"'][^\"']*\bleague\b[^\"']*[\"'][^>]*>(.*?)</div>", 1)
    mobile_kickoff = F.regexp_extract(match_text(mobile), r"\b\d{2}-\d{2}\s+(\d{2}:\d{2})", 1)
    return df.select(
        *_kept(df),
        match_text(league).alias("league"),
        F.coalesce(F.nullif(kickoff, F.lit("")), mobile_kickoff).alias("kickoff_raw"),
        F.regexp_replace(F.coalesce(_last_link(body, "home"), by_id("homeName")), r"\(主\)$", "").alias("home"),
        F.regexp_replace(F.coalesce(_last_link(body, "guest"), by_id("guestName")), r"\(客\)$", "").alias("away"),
    )
