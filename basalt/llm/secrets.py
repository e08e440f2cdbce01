"""Secret scans: fixed patterns, and strings that a character Markov model finds random. DataFrame functions only.

Two Markov models of character pairs, of random strings and of ordinary identifiers, are trained from labelled
samples that the corpus provides: values that the assignment pattern finds (random) and words, numbers, paths
and names of all documents outside such matches (ordinary), at most ``SAMPLE`` of each, those with the smallest md5.
Both are cut by the alphabet of tokens. Strings whose letters, digits and cases take turns more often than every
``LEAST_RUN`` characters, and strings with digits as long as the tokens that are judged, are not taken for ordinary ones: the corpus
holds secrets outside assignments too.
Each string is also learnt in capitals, on both sides: names in capitals are names, and keys in capitals are keys. A token of ``TOKEN_LENGTH`` or more
characters whose log-likelihood ratio reaches ``LEAST_RATIO`` per character, and which has not the form of a UUID, is a span of kind ``random`` unless it overlaps
a span of a pattern. The ratios of all pairs (128 x 128 at most) are a literal of the plan.

Positions: a text without its matches is what ``split`` gives, so running lengths of pieces and matches are
the matches' places in code points; they are summed by doubling, in n log n steps for n matches.

Defined cases: a null text is empty and has no spans; repeated rows give equal rows; without any match to
learn from, the model of random strings is uniform; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# Fixed values of the contract: patterns, least lengths and the order of the kinds.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

TOKEN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}"
LEARN_LEAST = 16
SAMPLE = 20_000
#: Least log-likelihood ratio per character.
LEAST_RATIO = 2.0
#: A random string has so many different characters at least; runs of few characters are no secrets.
LEAST_DISTINCT = 8
#: The form of a UUID (public format): random, but a name and no secret.
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
#: How many observations the plain character frequencies count for in a pair's probability.
BACK_OFF = 10
#: Part of a random string's probability that is uniform: labelled samples may all be of one alphabet, as hexadecimal.
UNIFORM = 0.5
#: Ordinary strings hold one change between letters and digits or to a capital in so many characters at most.
LEAST_RUN = 5
_IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
_CHANGE = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"
_DIGITS = [ord(c) for c in "0123456789"]
_MARKS = [ord(c) for c in "+/_=-"]
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, keep: Column | None = None, extra: Column | None = None) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping. ``keep``: a filter over the structs' fields
    start, end, match and, where given, extra."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("piece"), (extra if extra is not None else F.lit(None).cast("array<string>")).alias("extra"))

    def add(state: Column, _: Column) -> Column:
        at, step = state["at"], state["step"]
        return F.struct(F.transform(at, lambda x, i: x + F.when(i >= step, F.get(at, i - step)).otherwise(0)).alias("at"), (step * 2).alias("step"))

    def spans(p: Column) -> Column:
        lengths = F.zip_with(p["piece"], F.concat(F.array(F.lit("")), p["match"]), lambda a, b: F.length(a) + F.length(b))
        start = F.struct(lengths.alias("at"), F.lit(1).alias("step"))
        doublings = F.ceil(F.log2(F.size(p["piece"]).cast("double"))).cast("int")
        begins = F.aggregate(F.sequence(F.lit(0), doublings), start, add, lambda s: s["at"])
        zipped = F.arrays_zip(F.slice(begins, 1, F.size(p["match"])).alias("start"), p["match"].alias("match"), *([p["extra"].alias("extra")] if extra is not None else []))
        return F.filter(zipped, keep) if keep is not None else zipped

    whole = F.get(F.transform(F.array(parts), spans), F.lit(0))  # the arrays are made once
    named = F.transform(whole, lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["match"])).cast("int").alias("end")))
    return F.when(text.rlike(pattern), named).otherwise(F.array().cast(_SPAN))


def _neighbours(text: Column, of) -> Column:
    """``of`` each pair of neighbouring characters (as 128 * first + second), then a null: one walk over the text."""
    chars = F.split(text, "")
    return F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), of(F.ascii(a) * 128 + F.ascii(b))))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of character pairs (as 128 * first + second) of the column ``s`` and of the same in capitals."""
    both = strings.select(F.explode(F.array_distinct(F.array("s", F.upper("s")))).alias("s"))
    pairs = F.filter(_neighbours(F.col("s"), lambda pair: pair), lambda p: p.isNotNull())
    return both.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> str:
    """Log-likelihood ratios of all character pairs, as text: random over ordinary.

    The probability of a character after another backs off to the character's own, which has add-one counts. Each
    pair of digits and each pair of a mark with a letter or digit counts once more on the ordinary side: numbers and
    joined names are ordinary. Pairs with a character that neither
    side holds, or with a mark that no ordinary string holds, tell nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = docs.filter(text.rlike(ASSIGN)).select(F.explode(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).alias("s"))
    random = hit.filter(F.length("s") >= LEARN_LEAST).distinct().orderBy(F.md5("s")).limit(SAMPLE)
    free = F.regexp_replace(text, F.lit(ASSIGN), F.lit(" "))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(free, F.lit(_IDENTIFIER), F.lit(0)))).alias("s"))
    ordinary = words.filter(((F.length("s") < TOKEN_LENGTH) | ~F.col("s").rlike("[0-9]")) & ((F.size(F.split("s", _CHANGE)) - 1) * LEAST_RUN <= F.length("s"))).distinct().orderBy(F.md5("s")).limit(SAMPLE)
    counts: dict[int, list[int]] = {}
    for side, table in enumerate((random, ordinary)):
        for row in _pairs(table).collect():  # at most 128 x 128 rows
            counts.setdefault(row["pair"], [0, 0])[side] += row["n"]
    chars = 66  # letters, digits and + / _ = are what tokens are made of; add-one over them
    first = [[0] * 128, [0] * 128]
    second = [[0] * 128, [0] * 128]
    for pair, n in counts.items():
        for side in (0, 1):
            first[side][pair // 128] += n[side]
            second[side][pair % 128] += n[side]
    held = [{c for c in range(128) if first[side][c] or second[side][c]} for side in (0, 1)]
    mute = {c for c in range(128) if c not in held[1] and (c not in held[0] or c in _MARKS)}
    of_second = [sum(second[side]) for side in (0, 1)]
    parts = [c for c in range(128) if chr(c).isalnum()]
    for pair in {128 * a + b for a in _DIGITS for b in _DIGITS} | {p for m in _MARKS for c in parts for p in (128 * m + c, 128 * c + m)}:
        counts.setdefault(pair, [0, 0])[1] += 1
        first[1][pair // 128] += 1

    def likely(side: int, pair: int) -> float:
        alone = (second[side][pair % 128] + 1) / (of_second[side] + chars)
        p = (counts.get(pair, (0, 0))[side] + BACK_OFF * alone) / (first[side][pair // 128] + BACK_OFF)
        return p if side else UNIFORM / chars + (1 - UNIFORM) * p

    ratios = [0.0 if pair // 128 in mute or pair % 128 in mute else math.log(likely(0, pair)) - math.log(likely(1, pair)) for pair in range(128 * 128)]
    return ",".join(f"{r:.9f}" for r in ratios)


def _ratio(token: Column, table: Column) -> Column:
    return F.aggregate(_neighbours(token, lambda pair: F.get(table, pair)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind."""
    assign = _places(text, ASSIGN, 0, lambda s: F.length(s["extra"]) >= ASSIGN_LEAST, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    access = F.when(text.contains("AKIA"), _places(text, ACCESS, 1, lambda s: F.length(s["match"]) >= ACCESS_LEAST)).otherwise(F.array().cast(_SPAN))
    return F.array_sort(F.concat(assign, access, _places(text, HEX, 2)))


def random_spans(text: Column, ratios: str) -> Column:
    """Spans of tokens whose likelihood ratio reaches ``LEAST_RATIO``."""
    table = F.split(F.lit(ratios), ",").cast("array<double>")  # folded to one literal
    mixed = lambda s: F.size(F.array_distinct(F.split(s["match"], ""))) >= LEAST_DISTINCT
    return _places(text, TOKEN, 3, lambda s: mixed(s) & ~s["match"].rlike(f"^{UUID}$") & (_ratio(s["match"], table) >= LEAST_RATIO * F.length(s["match"])))


def has_secret(text: Column, ratios: str) -> Column:
    """Whether a text holds any span."""
    text = F.coalesce(text, F.lit(""))
    return (F.size(base_spans(text)) > 0) | (F.size(random_spans(text, ratios)) > 0)


def scan(docs: DataFrame, ratios: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the spans found, as arrays of (start, kind, end): ``base``, ``found``."""
    ratios = train(docs) if ratios is None else ratios
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = rows.select("doc_id", base_spans(F.col("text")).alias("base"), random_spans(F.col("text"), ratios).alias("random"))
    free = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", free)).alias("found"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` over the whole of ``documents``, digested to the contract's columns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("found")).alias("spans")
    )


def _sql() -> str:
    """The same rows in DuckDB SQL, with the same model."""

    def spans(name: str, pattern: str, kind: int, extra: str = "", keep: str = "true") -> str:
        q = pattern.replace("'", "''")
        return rf"""{name} as (
  select doc_id, {kind} as kind, s as start, s + len(m) as "end", m, x from (
    select doc_id, unnest(ms) as m, unnest(xs) as x,
      unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda y: len(y))), 0))) as s
    from (select doc_id, regexp_extract_all(text, '{q}') as ms, string_split_regex(text, '{q}') as ps, {extra or f"regexp_extract_all(text, '{q}')"} as xs from d))
  where {keep})"""

    q = ASSIGN.replace("'", "''")
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
{spans("a", ASSIGN, 0, f"regexp_extract_all(text, '{q}', 2)", f"len(x) >= {ASSIGN_LEAST}")},
{spans("k", ACCESS, 1, "", f"len(m) >= {ACCESS_LEAST}")},
{spans("h", HEX, 2)},
{spans("t", TOKEN, 3, "", f"len(list_distinct(string_split(m, ''))) >= {LEAST_DISTINCT} and not regexp_full_match(m, '{UUID}')")},
pos as (select s from (select distinct unnest(regexp_extract_all(text, '{q}', 2)) as s from d) where len(s) >= {LEARN_LEAST} order by md5(s) limit {SAMPLE}),
ord as (
  select s from (select distinct unnest(regexp_extract_all(regexp_replace(text, '{q}', ' ', 'g'), '{_IDENTIFIER}')) as s from d)
  where len(list_filter(range(1, len(s)), lambda i: regexp_full_match(s[i:i+1], '[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]'))) * {LEAST_RUN} <= len(s) and (len(s) < {TOKEN_LENGTH} or not regexp_matches(s, '[0-9]')) order by md5(s) limit {SAMPLE}),
cased as (select 0 as side, s from pos union all select 0, upper(s) from pos where upper(s) <> s union all select 1, s from ord union all select 1, upper(s) from ord where upper(s) <> s),
pairs as (
  select side, unnest(list_transform(range(1, len(s)), lambda i: s[i:i])) as a, unnest(list_transform(range(1, len(s)), lambda i: s[i+1:i+1])) as b from cased),
seen as (select a, b, count(*) filter (side = 0) as r, count(*) filter (side = 1) as o from pairs group by a, b),
held as (select side, a as c from pairs union select side, b from pairs),
part as (select unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', '')) as c),
mark as (select unnest(['+', '/', '_', '=', '-']) as c),
more as (
  select x.c as a, y.c as b from part x, part y where x.c between '0' and '9' and y.c between '0' and '9'
  union all select mark.c, part.c from mark, part union all select part.c, mark.c from mark, part),
n as (select a, b, sum(r) as r, sum(o) as o from (select a, b, r, o from seen union all select a, b, 0, 1 from more) group by a, b),
tot as (select a, sum(r) as r, sum(o) as o from n group by a),
alone as (select b, sum(r) as r, sum(o) as o from seen group by b),
sums as (select coalesce(sum(r), 0) as r, coalesce(sum(o), 0) as o from seen),
told as (select c from held where side = 1 union select c from held where side = 0 and c not in (select c from mark)),
tp as (select doc_id, start, "end", unnest(list_transform(range(1, len(m)), lambda i: m[i:i])) as a, unnest(list_transform(range(1, len(m)), lambda i: m[i+1:i+1])) as b from t),
llr as (
  select doc_id, start, "end", sum(case when tp.a in (select c from told) and tp.b in (select c from told) then round(
    ln({UNIFORM}::double / 66 + (1 - {UNIFORM}::double) * ((coalesce(n.r, 0) + {BACK_OFF} * ((coalesce(alone.r, 0) + 1) / (sums.r + 66))) / (coalesce(tot.r, 0) + {BACK_OFF}))) -
    ln((coalesce(n.o, 0) + {BACK_OFF} * ((coalesce(alone.o, 0) + 1) / (sums.o + 66))) / (coalesce(tot.o, 0) + {BACK_OFF})), 9) else 0 end) as ratio
  from tp cross join sums left join n using (a, b) left join tot on tot.a = tp.a left join alone on alone.b = tp.b group by all),
base as (select doc_id, kind, start, "end" from a union all select doc_id, kind, start, "end" from k union all select doc_id, kind, start, "end" from h),
every as (
  select *, true as is_base from base union all
  select doc_id, 3, start, "end", false from llr
  where ratio >= {LEAST_RATIO} * ("end" - start) and not exists (select 1 from base b where b.doc_id = llr.doc_id and b.start < llr."end" and llr.start < b."end")),
named as (select *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || "end" as name from every),
g as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(name, ',' order by start, kind) filter (is_base) as base, string_agg(name, ',' order by start, kind) as spans from named group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)
"""


OP5_SQL = _sql()
