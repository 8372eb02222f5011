"""Secret scan: fixed patterns, and sliding-window Shannon entropy of candidate strings.

Only SQL functions. Spans are code points, end exclusive. A pattern's matches are located from
the text between them: the lengths of what ``split`` and ``regexp_extract_all`` return alternate.

The entropy scan looks at runs of one character class. A window of ``width`` characters slides over
each run; counts of its characters are kept, and the sum of c log2 c changes by the two terms of
the character that enters and the one that leaves, so a step costs the same at any width. Windows
at or above the class's threshold that touch are one span. Runs on the allow-list (plain words,
numbers, UUIDs, documented examples, integrity digests) give no entropy span; spans of the fixed
patterns always stay.

Lists that grow in ``aggregate`` would be copied for each entry. They grow in blocks of ``BLOCK`` entries
and a list of full blocks, and texts are cut by blocks of characters, so that the work stays in proportion
to the text, however many matches it has.

Defined cases. Null text is empty; an empty text has no spans and the digest of the empty string.
Repeated rows each get their result. Columns besides doc_id and text are passed on or not looked at; a
column named spans gives way to the result of ``scan`` and is passed on by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlife.llm.storage import replaced

BLOCK = 128  # entries of a list that are copied together
CHARS = 4096  # characters of a text that are looked up together

# Fixed values of the contract, in the order in which kinds are listed.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a longest run, so the same as all runs of 16 and more
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8


@dataclass(frozen=True)
class CharClass:
    kind: str
    alphabet: str
    pattern: str
    threshold: float


WIDTH = 20
CLASSES = (
    CharClass("entropy64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", r"[A-Za-z0-9+/=_-]{20,}", 3.9),
    CharClass("entropy16", "0123456789abcdefABCDEF", r"[0-9a-fA-F]{20,}", 3.0),
)
ALLOWED = r"^[-_/+=]*([A-Z]?[a-z]+|[A-Z]+)([-_/+=]+([A-Z]?[a-z]+|[A-Z]+))*[-_/+=]*$|^[-_/+=0-9]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|EXAMPLE|^sha(256|384|512)-"
# The same for Java, which repeats a possessive group in a loop; a greedy one takes stack for each part of a run.
ALLOWED_JAVA = ALLOWED.replace("([-_/+=]+([A-Z]?[a-z]+|[A-Z]+))*", "([-_/+=]++([A-Z]?[a-z]++|[A-Z]++))*+")


def grown(entry: str, when: str = "true") -> str:
    """SQL for the fields ``block`` and ``blocks`` of state ``s`` after ``entry`` is added where ``when`` holds."""
    full = f"size(s.block) >= {BLOCK}"
    block = f"case when not ({when}) then s.block when {full} then array({entry}) else concat(s.block, array({entry})) end"
    return f"{block} as block, if(({when}) and {full}, concat(s.blocks, array(s.block)), s.blocks) as blocks"


def empty_list(kind: str) -> str:
    """SQL for the fields before the first entry."""
    return f"cast(array() as array<{kind}>) as block, cast(array() as array<array<{kind}>>) as blocks"


LISTED = "concat(flatten(s.blocks), s.block)"


def located(text: str, pattern: str) -> Column:
    """Array of (at, hit): the matches of ``pattern`` in column ``text``, leftmost and not overlapping."""
    parts = f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, h) -> struct(length(g) as g, h))"
    kind = "struct<at: int, hit: string>"
    step = f"struct(s.at + x.g + coalesce(length(x.h), 0) as at, {grown('struct(s.at + x.g as at, x.h as hit)', 'x.h is not null')})"
    found = f"aggregate({parts}, struct(0 as at, {empty_list(kind)}), (s, x) -> {step}, s -> {LISTED})"
    return F.expr(f"if({text} rlike r'{pattern}', {found}, cast(array() as array<{kind}>))")


def _spans(hits: str, kind: str, rank: int, where: str = "true") -> Column:
    return F.expr(f"transform(filter({hits}, h -> {where}), h -> struct(h.at as start, {rank} as rank, h.at + length(h.hit) as end, '{kind}' as kind))")


def high_windows(c: CharClass, run: str, width: int = WIDTH) -> str:
    """SQL for the array of (low, high) spans in string ``run`` whose windows reach the threshold."""
    codes = f"transform(split({run}, ''), ch -> instr('{c.alphabet}', ch))"
    table = "array(" + ", ".join("0D" if n < 2 else f"{n}D * log2({n}D)" for n in range(width + 2)) + ")"
    # x: position (from 1), character that enters, character that leaves (0: none)
    # The codes are bound to a name, so that they are made once for the run and not once for each character.
    feed = f"element_at(transform(array({codes}), codes -> transform(codes, (code, i) -> struct(i + 1 as at, code as enters, if(i >= {width}, element_at(codes, i + 1 - {width}), 0) as leaves))), 1)"
    table_of = lambda count: f"element_at({table}, {count} + 1)"
    came, went = "element_at(s.counts, x.enters)", "element_at(s.counts, x.leaves)"
    total = f"s.total + if(x.enters = x.leaves, 0D, {table_of(came + ' + 1')} - {table_of(came)} + if(x.leaves = 0, 0D, {table_of(f'{went} - 1')} - {table_of(went)}))".replace(went, "element_at(s.counts, greatest(x.leaves, 1))").replace("element_at(s.counts, greatest(x.leaves, 1)) - 1", "greatest(element_at(s.counts, greatest(x.leaves, 1)) - 1, 0)")
    counts = "transform(s.counts, (n, k) -> n + if(k + 1 = x.enters, 1, 0) - if(k + 1 = x.leaves, 1, 0))"
    span = "struct<low: int, high: int>"
    first = f"aggregate({feed}, struct(array_repeat(0, {len(c.alphabet)}) as counts, 0D as total, 0 as at, -1 as low, -1 as high, {empty_list(span)}), (s, x) -> "
    # The state after the counts moved, then the decision on the window that ends here. The span from low to high is open.
    moved = f"struct({counts} as counts, {total} as total, x.at as at, s.low as low, s.high as high, s.block as block, s.blocks as blocks)"
    high = f"(s.at >= {width} and log2({width}D) - s.total / {width} >= {c.threshold}D)"
    fresh = f"({high} and not (s.low >= 0 and s.high >= s.at - {width}))"
    closed = grown("struct(s.low as low, s.high as high)", f"{fresh} and s.low >= 0")
    decided = f"element_at(transform(array({moved}), s -> struct(s.counts as counts, s.total as total, s.at as at, if({fresh}, s.at - {width}, s.low) as low, if({high}, s.at, s.high) as high, {closed})), 1)"
    return f"{first}{decided}, s -> concat({LISTED}, if(s.low >= 0, array(struct(s.low as low, s.high as high)), cast(array() as array<{span}>))))"


def _scanned(docs: DataFrame) -> DataFrame:
    """(row, t, spans): the row as it is, its text, and its spans."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    row = row.select("row", "t", located("t", ASSIGN).alias("assign"), located("t", ACCESS).alias("access"), located("t", HEX).alias("hex"), *(located("t", c.pattern).alias(c.kind) for c in CLASSES))
    kinds = [
        _spans("assign", "assign", 1, f"length(regexp_extract(h.hit, r'{ASSIGN}', 2)) >= {ASSIGN_VALUE}"),
        _spans("access", "access", 2),
        _spans("hex", "hex", 3),
    ]
    for rank, c in enumerate(CLASSES, 4):
        runs = f"filter({c.kind}, h -> not h.hit rlike r'{ALLOWED_JAVA}')"
        kinds.append(F.expr(f"flatten(transform({runs}, h -> transform({high_windows(c, 'h.hit')}, w -> struct(h.at + w.low as start, {rank} as rank, h.at + w.high as end, '{c.kind}' as kind))))"))
    return row.select("row", "t", F.array_sort(F.concat(*kinds)).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs(text, …)`` with ``spans``: array of (start, rank, end, kind), sorted; ranks 1 to 3 are the fixed patterns."""
    return replaced(_scanned(docs), docs.columns, spans=F.col("spans"))


def written(spans: str = "spans", where: str = "true") -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform(filter({spans}, x -> {where}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)"""
    found = scan(docs.select("doc_id", "text"))
    count = lambda rank: F.expr(f"cast(size(filter(spans, x -> x.rank = {rank})) as long)")
    return found.select("doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), F.sha2(written(where="x.rank <= 3"), 256).alias("base_sha256"), written().alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; texts without spans stay as they are."""
    some = F.size("spans") > 0
    found = _scanned(docs).withColumn("parts", F.expr(f"if(size(spans) > 0, regexp_extract_all(t, '(?s).{{1,{CHARS}}}', 0), cast(array() as array<string>))"))
    # The characters from a up to b, from the blocks that hold them.
    low, high = f"(x.a div {CHARS})", f"(x.b div {CHARS})"
    one = f"substring(parts[cast({low} as int)], cast(x.a % {CHARS} as int) + 1, x.b - x.a)"
    last = f"coalesce(substring(get(parts, cast({high} as int)), 1, cast(x.b % {CHARS} as int)), '')"
    many = f"concat(substring(parts[cast({low} as int)], cast(x.a % {CHARS} as int) + 1), array_join(slice(parts, cast({low} as int) + 2, cast({high} - {low} as int) - 1), ''), {last})"
    cut = f"case when x.a >= x.b then '' when {low} = {high} then {one} else {many} end"
    # Gaps before spans that do not lie in earlier ones, and the rest.
    step = f"struct(greatest(s.at, x.end) as at, {grown('struct(s.at as a, x.start as b)', 'x.start >= s.at')})"
    gaps = f"aggregate(spans, struct(0 as at, {empty_list('struct<a: int, b: int>')}), (s, x) -> {step}, s -> concat({LISTED}, array(struct(s.at as a, length(t) as b))))"
    text = F.when(some, F.expr(f"array_join(transform({gaps}, x -> {cut}), {sql_text(mark)})")).otherwise(F.col("row.text"))
    found = found.withColumn("clean", text)

    def column(name: str) -> Column:
        if name.lower() == "text":
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.when(some, F.length("clean").cast(dict(docs.dtypes)[name])).otherwise(F.col("row.n_chars")).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return found.select(*(column(c) for c in docs.columns))


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_hits(kind: str, rank: int, pattern: str, value: str = "true") -> str:
    return f"""select doc_id, row_no, {rank} as rank, '{kind}' as kind, hit, length(array_to_string(gaps[1:n], '')) + length(array_to_string(hits[1:n - 1], '')) as start
  from (select doc_id, row_no, gaps, hits, unnest(hits) as hit, unnest(range(1, len(hits) + 1)) as n from (
    select doc_id, row_no, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as hits from docs))
  where {value}"""


def oracle() -> str:
    """DuckDB SQL for ``report``."""
    base = [_sql_hits("assign", 1, ASSIGN, f"length(regexp_extract(hit, '{ASSIGN}', 2)) >= {ASSIGN_VALUE}"), _sql_hits("access", 2, ACCESS), _sql_hits("hex", 3, HEX)]
    runs = [_sql_hits(c.kind, rank, c.pattern, f"not regexp_matches(hit, '{ALLOWED}')") for rank, c in enumerate(CLASSES, 4)]
    high = " or ".join(f"(kind = '{c.kind}' and list_aggregate(str_split(hit[w + 1:w + {WIDTH}], ''), 'entropy') >= {c.threshold})" for c in CLASSES)
    union = " union all ".join
    return f"""
with docs as (select doc_id, coalesce(text, '') as t, row_number() over () as row_no from documents),
base as ({union(base)}),
runs as ({union(runs)}),
windows as (select * from (select *, unnest(range(0, length(hit) - {WIDTH - 1})) as w from runs) where {high}),
marked as (select *, case when w - lag(w) over (partition by row_no, kind, start order by w) <= {WIDTH} then 0 else 1 end as fresh from windows),
islands as (select *, sum(fresh) over (partition by row_no, kind, start order by w) as island from marked),
spans as (
  select row_no, rank, kind, start::bigint as low, (start + length(hit))::bigint as high from base
  union all
  select row_no, rank, kind, (start + min(w))::bigint, (start + max(w) + {WIDTH})::bigint from islands group by row_no, rank, kind, start, island),
joined as (select row_no, count(*) filter (rank = 1) as n_assign, count(*) filter (rank = 2) as n_access, count(*) filter (rank = 3) as n_hex,
    string_agg(kind || ':' || low || ':' || high, ',' order by low, rank, high) filter (rank <= 3) as base,
    string_agg(kind || ':' || low || ':' || high, ',' order by low, rank, high) as spans
  from spans group by row_no)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (row_no)"""
