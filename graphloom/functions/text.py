"""Column functions for text: chunking, parsing, normalising and truncating. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: Python's str.strip() removes any white space; Spark's trim() only spaces.
_EDGES = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("long")


def chunk_array(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Overlapping windows of ``size`` tokens; the last one ends with the text; an empty text has none."""
    width = size * CHARS_PER_TOKEN
    step = width - overlap * CHARS_PER_TOKEN
    step = step if step > 0 else width
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - width) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(width)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def fixed_step_chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """One chunk if the text has at most ``size`` tokens, else a window at every step up to the end of the text."""
    if overlap >= size:
        raise ValueError("overlap must be under size: the windows would never end")
    width, step = size * CHARS_PER_TOKEN, (size - overlap) * CHARS_PER_TOKEN
    many = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / step).cast("int") - 1), lambda i: F.substring(text, i * step + 1, F.lit(width)))
    return F.when(token_estimate(text) <= size, F.array(text)).otherwise(many)


def mentions(text: Column) -> Column:
    """Capitalised words of at least four letters; no word boundary class, as engines differ on it."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}])(\p{Lu}\p{L}{3,})"), F.lit(1))


def normalize_entity(c: Column) -> Column:
    """Lower-cased, without a leading article, a final full stop and quotes around it."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"^(a|an|the)\s+", "")
    t = F.regexp_replace(t, r"\s*\.$", "")
    return F.regexp_replace(t, r"""^['"]+|['"]+$""", "")


def normalize_relation(c: Column, blank: str = "-") -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit(blank))


def normalize_triples(triples: Column, blank: str = "-") -> Column:
    """``array<array<string>>`` to sorted distinct ``array<struct<h,r,t>>``; other arities and empty ends go."""
    three = F.filter(triples, lambda x: F.size(x) == 3)
    named = F.transform(three, lambda x: F.struct(normalize_entity(x[0]).alias("h"), normalize_relation(x[1], blank).alias("r"), normalize_entity(x[2]).alias("t")))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: (x["h"] != "") & (x["t"] != ""))))


#: An answer that contains one of these counts as a failure.
INVALID_MARKERS = ("no communities found", "failed", "error", "not available", "unable to", "cannot", "empty", "null")


def valid_answer(c: Column) -> Column:
    hit = F.lower(strip(c)).rlike("|".join(INVALID_MARKERS))
    return F.coalesce((F.length(c) > 0) & ~hit, F.lit(False))


def truncate_answer(c: Column, cap: Column | int = 1400) -> Column:
    """At most ``cap`` characters: up to the last sentence end if that lies beyond 80 %, else with dots."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    head = F.substring(c, F.lit(1), cap.cast("int"))
    back = F.reverse(head)
    places = [F.when(F.instr(back, m) > 0, F.length(head) - F.instr(back, m)).otherwise(-1) for m in (".", "?", "!")]
    end = F.greatest(*places)  # from 0
    cut = F.when(end > cap * 0.8, F.substring(c, F.lit(1), end + 1)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(c) <= cap, c).otherwise(cut)


def clean_verdict(c: Column) -> Column:
    v = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(v.isin("A", "B", "TIE"), v).otherwise("TIE")


def numbered_lines(text: Column, limit: int, words: tuple[str, ...] = ("User", "Task", "Question")) -> Column:
    """Texts after the first colon of lines that name one of ``words`` or start with a digit; the first ``limit``."""
    lines = F.transform(F.split(text, "\n"), strip)
    marked = F.filter(lines, lambda x: x.rlike("^[0-9]|" + "|".join(words)) & x.contains(":"))
    found = F.filter(F.transform(marked, lambda x: strip(F.regexp_replace(x, r"^[^:]*:", ""))), lambda x: x != "")
    return F.slice(found, 1, limit)


DELIMITER = "<|>"


def extraction_records(response: Column, delimiter: str = DELIMITER, record: str | None = "##") -> Column:
    """Parsed lines of an extraction response: ``array<struct<kind, a, b, description, weight, ord>>``.

    ``record`` also splits records within a line; with None it stays, as in a
    parser that never splits it. All closing parentheses go, as the format says
    nothing about escaping. ``ord`` counts from 0 within each kind.
    """
    text = F.replace(response, F.lit(record), F.lit("\n")) if record else response
    lines = F.transform(F.split(text, "\n"), strip)

    def parse(kind: str, n: int):
        head = f'("{kind}"'
        mine = F.filter(lines, lambda x: x.startswith(head))
        parts = F.transform(mine, lambda x: F.transform(F.split(F.replace(F.replace(x, F.lit(head + delimiter), F.lit("")), F.lit(")"), F.lit("")), delimiter.replace("|", "\\|")), strip))
        parts = F.filter(parts, lambda p: F.size(p) >= 3)
        weight = (lambda p: F.coalesce(F.try_element_at(p, F.lit(4)).try_cast("double"), F.lit(1.0))) if kind == "relationship" else (lambda p: F.lit(None).cast("double"))
        return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), p[0].alias("a"), p[1].alias("b"), p[2].alias("description"), weight(p).alias("weight"), i.alias("ord")))

    return F.concat(parse("entity", 3), parse("relationship", 4))


def constructor_triples(completion: Column) -> Column:
    """``array<struct<head_type, head, relation, tail_type, tail>>`` of constructor calls, read by pattern, never run."""
    body = F.regexp_extract(completion, r"(?is)extract\s*=\s*Extract\s*\(\s*(\[.*?\])\s*\)", 1)
    call = r"""Triple\(\s*(\w+)\(\s*['"]([^'"]*)['"]\s*\)\s*,\s*(\w+)\(\s*\)\s*,\s*(\w+)\(\s*['"]([^'"]*)['"]\s*\)\s*\)"""
    fields = ("head_type", "head", "relation", "tail_type", "tail")
    groups = [F.regexp_extract_all(body, F.lit(call), F.lit(i + 1)) for i in range(5)]
    return F.arrays_zip(*[g.alias(n) for g, n in zip(groups, fields, strict=True)])


REPORT_SCHEMA = "title string, summary string, rating string, rating_explanation string, findings array<struct<summary:string,explanation:string>>"


def report_struct(content: Column) -> Column:
    """A report from a model's JSON, fenced or not; from other text its ``# `` title and first body line.

    ``struct<title, summary, rating double, rating_explanation, full_content>``.
    """
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?(.*?)```", 1)
    body = strip(F.when(content.contains("```") & (fenced != ""), fenced).otherwise(content))
    j = F.from_json(body, REPORT_SCHEMA, {"mode": "PERMISSIVE"})
    is_json = body.startswith("{") & F.coalesce(j["title"], j["summary"], j["rating"], j["rating_explanation"], F.to_json(j["findings"])).isNotNull()
    rating = F.coalesce(j["rating"].try_cast("double"), F.lit(0.0))
    title = F.coalesce(j["title"], F.lit("Community Report"))
    summary = F.coalesce(j["summary"], F.lit(""))
    why = F.coalesce(j["rating_explanation"], F.lit(""))
    items = F.transform(F.coalesce(j["findings"], F.from_json(F.lit("[]"), "array<struct<summary:string,explanation:string>>")), lambda f, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". **"), F.coalesce(f["summary"], F.lit("")), F.lit("**"), F.when(F.coalesce(f["explanation"], F.lit("")) != "", F.concat(F.lit("\n   - "), f["explanation"])).otherwise("")))
    full = F.concat(F.lit("# "), title, F.lit("\n\n**Summary:** "), summary, F.lit("\n\n**Rating:** "), rating.cast("string"), F.lit("/5.0\n**Rating Explanation:** "), why, F.when(F.size(items) > 0, F.concat(F.lit("\n\n## Key Findings:\n"), F.array_join(items, "\n"))).otherwise(""))
    plain = F.replace(F.replace(content, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    lines = F.transform(F.split(plain, "\n"), strip)
    heads = F.filter(lines, lambda x: x.startswith("# "))
    text = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("**Summary**"))
    return F.when(is_json, F.struct(title.alias("title"), summary.alias("summary"), rating.alias("rating"), why.alias("rating_explanation"), full.alias("full_content"))).otherwise(
        F.struct(
            F.coalesce(F.substring(F.try_element_at(heads, F.lit(1)), F.lit(3), F.length(content)), F.lit("Community Report")).alias("title"),
            F.coalesce(F.try_element_at(text, F.lit(1)), F.lit("")).alias("summary"),
            F.lit(0.0).alias("rating"),
            F.lit("").alias("rating_explanation"),
            plain.alias("full_content"),
        )
    )


def to_int_id(c: Column, fallback: Column) -> Column:
    """An integer as it is, else the first run of digits, else ``fallback``."""
    digits = F.regexp_extract(c.cast("string"), r"(\d+)", 1)
    return F.coalesce(c.cast("string").try_cast("bigint"), F.when(digits != "", digits.try_cast("bigint")), fallback)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
