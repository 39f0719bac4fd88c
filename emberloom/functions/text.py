"""Text functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def strip(c: Column) -> Column:
    """Without white space at the ends, the ideographic space and byte order mark included."""
    return F.regexp_replace(c, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def clean_name(name: Column) -> Column:
    """Without [n] reference marks, trimmed."""
    return strip(F.regexp_replace(name, r"\[\d+\]", ""))


def extract_location(detail: Column, names: list[str] | None = None, default: str = vocab.NOWHERE, most: int = 3) -> Column:
    """The first `most` names, in vocabulary order, that the text contains."""
    found = F.filter(_lits(names or vocab.PREFECTURES + vocab.OLD_PROVINCES), lambda n: F.contains(detail, n))
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, most), "、")).otherwise(default)


def extract_summary(detail: Column, sentences: int = 3, limit: int = 200, ends: str = "。！？") -> Column:
    """The first sentences of the first non-blank paragraph, cut at `limit` characters."""
    lines = F.split(F.regexp_replace(detail, r"\[\d+\]", ""), "\n")
    first = F.coalesce(F.try_element_at(F.filter(lines, lambda x: strip(x) != ""), F.lit(1)), F.lit(""))
    text = strip(F.array_join(F.slice(F.split(first, f"(?<=[{ends}])"), 1, sentences), ""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def embedding_text(name: Column, summary: Column, location: Column) -> Column:
    place = F.when(~blank(location) & (location != vocab.NOWHERE), F.concat(F.lit("地域: "), location))
    return strip(F.concat_ws(" ", F.when(F.coalesce(name, F.lit("")) != "", name), F.when(F.coalesce(summary, F.lit("")) != "", summary), place))


def topic_document(name: Column, summary: Column) -> Column:
    return F.concat(F.lit("passage: "), name, F.lit("。"), summary)


def tokens(text: Column, pattern: str = r"[\p{L}\p{N}]+", least: int = 2, prefix: str = "passage: ") -> Column:
    """Words of at least `least` characters, of the lower-cased text without its prefix."""
    body = F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)
    return F.filter(F.regexp_extract_all(F.lower(body), F.lit(f"({pattern})"), F.lit(1)), lambda w: F.length(w) >= least)


def normalize_name(name: Column) -> Column:
    """The text before the first list comma, without bracketed parts."""
    first = strip(F.substring_index(F.substring_index(name, "、", 1), ",", 1))
    return strip(F.regexp_replace(first, r"\[.*?\]", ""))


def _longest_first(parts: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(parts.items(), key=lambda kv: -len(kv[0]))  # stable: of equal length in vocabulary order


def _detect(name: Column, parts: dict[str, str], meets: Callable, rest: Callable) -> Column:
    """One lookup in an array of parts, longest first, instead of a branch for each."""
    table = F.array(*[F.struct(F.lit(p).alias("component"), F.lit(c).alias("category")) for p, c in _longest_first(parts)])
    hits = F.filter(table, lambda x: meets(name, x["component"]) & (F.length(name) > F.length(x["component"])))
    cut = F.transform(F.slice(hits, 1, 1), lambda x: F.struct(x["component"].alias("component"), x["category"].alias("category"), rest(name, F.length(name) - F.length(x["component"])).alias("remaining")))
    return F.get(cut, F.lit(0))


def detect_suffix(name: Column, parts: dict[str, str] | None = None) -> Column:
    """(component, category, remaining) of the longest ending that leaves something over, or null."""
    return _detect(name, parts or vocab.SUFFIXES, F.endswith, F.left)


def detect_prefix(name: Column, parts: dict[str, str] | None = None) -> Column:
    return _detect(name, parts or vocab.PREFIXES, F.startswith, F.right)


def detect_embedded(name: Column, parts: dict[str, str] | None = None) -> Column:
    """(component, category, index) of each component whose first occurrence is strictly inside."""
    parts = parts or {**vocab.SUFFIXES, **vocab.PREFIXES}
    table = F.array(*[F.struct(F.lit(p).alias("component"), F.lit(c).alias("category")) for p, c in _longest_first(parts)])
    placed = F.transform(table, lambda x: F.struct(x["component"].alias("component"), x["category"].alias("category"), (F.instr(name, x["component"]) - 1).alias("index")))
    return F.filter(placed, lambda x: (x["index"] > 0) & (x["index"] < F.length(name) - F.length(x["component"])))


def slot_pattern(prefix_category: Column, suffix_category: Column) -> Column:
    bracket = lambda c: F.when(c.isNotNull(), F.concat(F.lit("["), c, F.lit("]")))
    both = F.concat_ws(" + ", bracket(prefix_category), F.lit("[BASE]"), bracket(suffix_category))
    return F.when(prefix_category.isNotNull() | suffix_category.isNotNull(), both).otherwise("")


def classify(text: Column, types: dict[str, list[str]] | None = None) -> Column:
    """The first type, by priority, with a keyword in the text; null if none or the text is empty."""
    out = F.lit(None).cast("string")
    for name, words in reversed(list((types or vocab.PHENOMENA).items())):
        out = F.when(F.exists(_lits(words), lambda w: F.contains(text, w)), name).otherwise(out)
    return out


def parse_regions(location: Column, regions: dict[str, list[str]] | None = None) -> Column:
    """The distinct regions of a list of places; a place in none is left out."""
    to_region = _map({p: r for r, places in (regions or vocab.REGIONS).items() for p in places})
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(location, F.lit("")), "，", "、"), "、"), lambda p: F.try_element_at(to_region, strip(p)))
    return F.when(blank(location) | (location == vocab.NOWHERE), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda r: r.isNotNull())))


def primary_region(location: Column, regions: dict[str, list[str]] | None = None) -> Column:
    return F.try_element_at(parse_regions(location, regions), F.lit(1))


def search_query(text: Column, answers: Column) -> Column:
    """The search sentence of an experience: its text without the first line break, and
    what the answers (a map) say of perception, place, time, impression and nature."""
    get = lambda k: F.coalesce(F.try_element_at(answers, F.lit(k)), F.lit(""))
    said = lambda k, before, after: F.when(~blank(get(k)), F.concat(F.lit(before), get(k), F.lit(after))).otherwise("")
    context = F.concat(said("perception", "", ""), said("when", "", "のころ、"), said("where", "", "で"), said("impression", "その体験は", "。"), said("nature", "それは", "。"))
    body = F.regexp_replace(text, r"(?s)^([^\n]*)\n(.*)$", "$1$2")
    return F.concat(F.concat_ws("。", body, F.when(context != "", context)), F.lit("。"))


def fill_template(lines: list[str], fields: dict[str, Column], drop_blank: bool = False) -> Column:
    """Lines with {name} places, joined by line breaks. A line of a null field is left out;
    drop_blank: blank lines are left out too."""
    out = []
    for line in lines:
        parts, rest = [], line
        while "{" in rest:
            head, _, tail = rest.partition("{")
            name, _, rest = tail.partition("}")
            parts += [F.lit(head), fields[name]]
        out.append(F.concat(*parts, F.lit(rest)))
    rows = F.array(*out)
    keep = (lambda x: x.isNotNull() & (x != "")) if drop_blank else (lambda x: x.isNotNull())
    return F.array_join(F.filter(rows, keep), "\n")


def scene(answers: Column, labels: dict[str, str]) -> Column:
    """'Label: value' of each answer that is given, joined by '. ' and ended by '.'; null if none is."""
    parts = [F.when(~blank(F.try_element_at(answers, F.lit(k))), F.concat(F.lit(f"{label}: "), F.try_element_at(answers, F.lit(k)))) for k, label in labels.items()]
    text = F.concat_ws(". ", *parts)
    return F.when(text != "", F.concat(text, F.lit(".")))


def reference_lines(items: Column) -> Column:
    """'- name（location）: content' for each struct of an array."""
    place = lambda f: F.when(F.coalesce(f["location"], F.lit("")) != "", F.concat(F.lit("（"), f["location"], F.lit("）"))).otherwise("")
    return F.array_join(F.transform(items, lambda f: F.concat(F.lit("- "), f["name"], place(f), F.lit(": "), f["content"])), "\n")


def signature(answers: Column, joiner: str = "|") -> Column:
    """key:value of a map's entries in order of key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(answers)), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("")))), joiner)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def _first_unit(c: Column) -> Column:
    """The first UTF-16 unit of a character: beyond U+FFFF its high surrogate."""
    n = F.ascii(c)
    return F.when(n > 0xFFFF, F.shiftright(n - 0x10000, 10) + 0xD800).otherwise(n)


def rolling_hash(text: Column, modulus: int = 9973) -> Column:
    return F.aggregate(_characters(text), F.lit(0), lambda a, c: (a + _first_unit(c)) % modulus)


def client_seed(text: Column, i: Column, modulus: int = 997) -> Column:
    """Over all UTF-16 units, two of a character beyond U+FFFF."""
    second = lambda c: F.when(F.ascii(c) > 0xFFFF, F.ascii(c) % 0x400 + 0xDC00).otherwise(0)
    total = F.aggregate(_characters(text), F.lit(0).cast("long"), lambda a, c: a + _first_unit(c) + second(c))
    return (F.abs(total) + i) % modulus


def parse_reply(text: Column) -> Column:
    """Candidates in a model's reply: the widest [...] as an array of objects, else the widest
    {...} as one; missing or empty fields get defaults."""
    one = "struct<name:string,reading:string,description:string,type:string>"
    rows = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), f"array<{one}>")
    single = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), one)
    either = lambda c, d: F.when(F.coalesce(c, F.lit("")) == "", d).otherwise(c)
    shape = lambda x, kind: F.struct(F.lit("llm").alias("source"), either(x["name"], "名無し").alias("name"), either(x["reading"], "").alias("reading"), either(x["description"], "").alias("description"), F.lit("llm-generated").alias("label"), either(x["type"], kind).alias("naming_type"))
    many = F.transform(rows, lambda x: shape(x, "unknown"))
    found = (F.size(F.coalesce(rows, F.array().cast(f"array<{one}>"))) > 0) & ~F.forall(F.coalesce(rows, F.array().cast(f"array<{one}>")), lambda x: x.isNull())
    lone = F.when(F.regexp_extract(text, r"(?s)\{.*\}", 0) != "", F.array(shape(single, "place_action")))
    return F.when(found, many).otherwise(lone)


def retry_delay_ms(text: Column) -> Column:
    """'500ms', '12s' or plain milliseconds; null if it is none of them."""
    body = strip(text)
    ms = F.regexp_extract(body, r"^(\d+(?:\.\d+)?)ms$", 1)
    sec = F.regexp_extract(body, r"^(\d+(?:\.\d+)?)s$", 1)
    plain = F.regexp_extract(body, r"^(\d+(?:\.\d+)?)$", 1)
    value = lambda c: F.when(c != "", c.cast("double"))
    return F.coalesce(value(ms), value(sec) * 1000, value(plain))


def data_uri_bytes(uri: Column) -> Column:
    """The decoded payload of a data URI, or of bare base64."""
    return F.unbase64(F.when(F.contains(uri, F.lit(",")), F.substring_index(uri, ",", -1)).otherwise(uri))


def excerpt(text: Column, n: int = 120) -> Column:
    return F.substring(text, 1, n)


def strip_braces(text: Column) -> Column:
    return F.btrim(text, F.lit("{}' "))


def parse_multi_select(text: Column) -> Column:
    """['A', 'B'] or {A,B} as an array."""
    parts = F.split(F.regexp_replace(text, r"[\[\]{}'\"\s]", ""), ",")
    return F.filter(parts, lambda x: x != "")


def sparse_document(name: Column, summary: Column, location: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(location, F.lit("")))


def quote_url(text: Column) -> Column:
    """Percent-encoding that keeps slashes and writes a space as %20."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), "%2F", "/"), r"\*", "%2A").alias("quoted")


def first_number(*fields: Column) -> Column:
    """The first field that begins with an integer."""
    return F.coalesce(*[F.when(F.regexp_extract(f, r"^\s*(-?\d+)", 1) != "", F.regexp_extract(f, r"^\s*(-?\d+)", 1).cast("int")) for f in fields])


def is_rate_limited(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(status == 429, F.lit(False)) | low.rlike("resource exhausted|quota|rate limit")


def label_of(value: Column, labels: dict[str, str], default: str | None = None) -> Column:
    found = F.try_element_at(_map(labels), value)
    return found if default is None else F.coalesce(found, F.lit(default))
