"""License scans: phrases, and license texts found by diagonal voting. DataFrame functions only.

All rolling k-grams of a document's words are hashed and joined to the k-grams of the templates. A match at
document position p and template position t votes for the diagonal p - t. Each diagonal that has votes gathers those of its
neighbours, no further away than the template's ``reach`` (one word in five of its length, ``MOST_REACH`` at most, so
that inserted names and lost lines don't break a span). So a span is never longer than the template and two reaches,
whatever stands around it. One with ``LEAST_COVERAGE`` of the template's k-grams is verified: its words and the
template's are aligned (an edit distance over words), and ``LEAST_SIMILARITY`` of the longer must agree.

Templates resemble each other. A span's worth is the number of words that agree less those that don't; a verified span gives
way to one of more worth that covers half of it or more, and spans of equal worth stay. The labels of those left are the document's.

Each text is cut into words once; what is written then is its counts, places, the few k-grams that some template
holds, and the stretch of text around these with a letter for each word.

Defined cases: a null text is empty: no words, no places, no labels, score 0; repeated rows give equal rows;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .license_texts import TEXTS as TEMPLATES

# Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4
MOST_REACH = 20
LEAST_COVERAGE = 0.5
LEAST_SIMILARITY = 0.75
#: Words of a stretch in which overlapping spans meet.
STRETCH = 64
#: Letters that stand for words: the first for words of no template.
_LETTERS = 0x4E00


def _lowered(text: Column) -> Column:
    """Lower case. The Kelvin sign would become a plain k, so it is kept out; other letters beyond ASCII stay beyond it."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def _words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def reach(n_words: int) -> int:
    """How far apart merged diagonals of a template of so many words may lie."""
    return max(1, min(MOST_REACH, n_words // 5))


def vocabulary(texts: dict[str, str]) -> list[str]:
    return sorted({w for text in texts.values() for w in text.split(" ")})


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES, k: int = K) -> tuple[DataFrame, DataFrame]:
    """k-grams of all templates: gram, label, t (place), grams (their number), reach; and label, plain (a letter for each word)."""
    letter = {w: chr(_LETTERS + i) for i, w in enumerate(vocabulary(texts), 1)}
    rows = [(label, text.split(" "), reach(text.count(" ") + 1), "".join(letter[w] for w in text.split(" "))) for label, text in texts.items()]
    table = spark.createDataFrame(rows, "label string, words array<string>, reach int, plain string")
    grams = table.select("label", "reach", (F.size("words") - k + 1).alias("grams"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: _gram(F.col("words"), i, k))).alias("t", "gram"))
    return grams.select("gram", "label", "t", "grams", "reach"), table.select("label", "plain")


def _coded(words: Column, known: Column, texts: dict[str, str], k: int) -> Column:
    """The first place of ``known`` grams, and the words from there to the last, a letter each."""
    names = vocabulary(texts)
    letters = F.array(*(F.lit(chr(_LETTERS + i)) for i in range(len(names) + 1)))
    places = F.transform(known, lambda g: g["p"])
    first, last = F.array_min(places), F.array_max(places)
    some = F.slice(words, first + 1, last - first + k)
    return F.when(F.size(known) > 0, F.struct(first.alias("first"), F.array_join(F.transform(some, lambda w: F.get(letters, F.array_position(F.array(*map(F.lit, names)), w).cast("int"))), "").alias("words")))


def phrase_places(words: Column, phrases: dict[str, str] = PHRASES) -> list[Column]:
    """For each phrase the word positions where it stands."""

    def at(phrase: str) -> Column:
        parts = phrase.split(" ")

        def here(i: Column) -> Column:
            test = F.get(words, i) == parts[0]
            for j, part in enumerate(parts[1:], 1):
                test = test & (F.get(words, i + j) == part)
            return F.coalesce(test, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)

    return [at(p) for p in phrases]


def known_grams(words: Column, grams: list[int], k: int = K) -> Column:
    """(p, gram) of a document's k-grams that some template holds."""
    rolling = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(i.alias("p"), _gram(words, i, k).alias("gram"))))
    return F.filter(F.coalesce(rolling, F.array().cast("array<struct<p:int,gram:bigint>>")), lambda g: g["gram"].isin(grams))


def votes(found: DataFrame, template: DataFrame, k: int = K) -> DataFrame:
    """Spans to verify: key, label, start, end (words, end exclusive) of rows with ``key`` and ``known`` (``known_grams``)."""
    grams = found.filter(F.size("known") > 0).select("key", F.inline("known"))
    hits = grams.join(F.broadcast(template), "gram").select("key", "label", "grams", "reach", "t", "p", (F.col("p") - F.col("t")).alias("diagonal"))  # as large as the texts
    diagonals = hits.groupBy("key", "label", "grams", "reach", "diagonal").agg(F.collect_set("t").alias("ts"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    around = Window.partitionBy("key", "label").orderBy("diagonal").rangeBetween(-MOST_REACH, MOST_REACH)
    near = diagonals.withColumn("near", F.collect_list(F.struct("diagonal", "ts", "lo", "hi")).over(around))
    near = near.withColumn("near", F.filter("near", lambda d: F.abs(d["diagonal"] - F.col("diagonal")) <= F.col("reach")))
    n = F.size(F.array_distinct(F.flatten(F.col("near.ts"))))
    return near.filter(n / F.col("grams") >= LEAST_COVERAGE).select("key", "label", F.array_min("near.lo").alias("start"), (F.array_max("near.hi") + k).alias("end")).distinct()


def verified(spans: DataFrame, found: DataFrame, plain: DataFrame) -> DataFrame:
    """``spans`` whose words agree with their template's, with similarity and worth. ``found``: key, coded; ``plain``: see ``templates``."""
    own = spans.join(found.filter("coded is not null").select("key", "coded"), "key").join(F.broadcast(plain), "label")  # a row a template
    span = F.substr(F.col("coded.words"), F.col("start") - F.col("coded.first") + 1, F.col("end") - F.col("start"))
    longer = F.greatest(F.length(span), F.length("plain"))
    edits = F.levenshtein(span, F.col("plain"))
    told = own.select("key", "label", "start", "end", (1 - edits / longer).alias("similarity"), (longer - 2 * edits).alias("worth"))
    return told.filter(F.col("similarity") >= LEAST_SIMILARITY)


def best(spans: DataFrame) -> DataFrame:
    """``verified`` spans that no overlapping span of more worth covers by half or more."""
    dealt = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))))
    other = dealt.select("key", "stretch", F.col("start").alias("s"), F.col("end").alias("e"), F.col("worth").alias("more"))
    shared = F.least("end", "e") - F.greatest("start", "s")
    beaten = dealt.join(other, ["key", "stretch"]).filter((F.col("more") > F.col("worth")) & (2 * shared >= F.col("end") - F.col("start")))
    return spans.join(beaten.select("key", "label", "start", "end").distinct(), ["key", "label", "start", "end"], "left_anti")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the contract's columns of ``op8``."""
    spark = docs.sparkSession
    template, plain = templates(spark, texts)
    grams = [r["gram"] for r in template.select("gram").distinct().collect()]  # as many as the templates have
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(_lowered(F.coalesce("text", F.lit("")))).alias("words"))
    cut = rows.withColumn("known", known_grams(F.col("words"), grams)).select("doc_id", F.size("words").cast("long").alias("n_words"), F.array(*phrase_places(F.col("words"), phrases)).alias("places"), "known", _coded(F.col("words"), F.col("known"), texts, K).alias("coded"))
    base = materialize(cut.withColumn("key", F.monotonically_increasing_id()), "places")
    names = [F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    every = F.flatten("places")
    told = base.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_compact(F.array(*names)).alias("own"))
    spans = materialize(verified(votes(base, template), base, plain), "spans")
    said = best(spans).groupBy("key").agg(F.collect_set("label").alias("voted"), F.max("similarity").alias("similarity"))
    both = told.join(said, "key", "left")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("own")).alias("base_labels"),
        joined(F.concat("own", F.coalesce("voted", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("similarity", F.lit(0.0))).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` over the whole of ``documents``."""
    return scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tests = []
    for phrase, label in PHRASES.items():
        tests.append("select doc_id, p, '" + label + "' as label from w where " + " and ".join(f"ws[p + {i + 1}] = '{x}'" for i, x in enumerate(phrase.split(" "))))
    rows = ", ".join(f"('{label}', string_split('{text}', ' '), {reach(text.count(' ') + 1)})" for label, text in TEMPLATES.items())
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') as ws from documents),
w as (select doc_id, ws, unnest(range(0, len(ws))) as p from d),
base as ({" union all ".join(tests)}),
b as (select doc_id, count(*) as n, min(p) as lo, max(p) as hi from base group by doc_id),
tpl(label, ws, reach) as (values {rows}),
tg as (select label, reach, len(ws) - {K - 1} as grams, unnest(range(0, len(ws) - {K - 1})) as t, unnest(list_transform(range(1, len(ws) - {K - 2}), lambda i: array_to_string(ws[i:i + {K - 1}], ' '))) as gram from tpl),
dg as (select doc_id, unnest(range(0, len(ws) - {K - 1})) as p, unnest(list_transform(range(1, len(ws) - {K - 2}), lambda i: array_to_string(ws[i:i + {K - 1}], ' '))) as gram from d where len(ws) >= {K}),
hits as (select doc_id, label, grams, reach, t, p, p - t as diagonal from dg join tg using (gram)),
diag as (select doc_id, label, reach, diagonal from hits group by all),
cand as (
  select distinct doc_id, label, lo, hi from (
    select diag.doc_id, diag.label, diag.diagonal, h.grams, count(distinct h.t) as n, min(h.p) as lo, max(h.p) + {K} as hi
    from diag join hits h on h.doc_id = diag.doc_id and h.label = diag.label and h.diagonal between diag.diagonal - diag.reach and diag.diagonal + diag.reach
    group by diag.doc_id, diag.label, diag.diagonal, h.grams) where n / grams >= {LEAST_COVERAGE}),
span as (
  select doc_id, label, lo, hi, greatest(hi - lo, len(tpl.ws)) as longer,
    levenshtein(array_to_string(list_transform(d.ws[lo + 1:hi], lambda x: chr((1 + coalesce(list_position(list_sort(list_distinct(tpl.ws)), x), 0))::int)), ''),
      array_to_string(list_transform(tpl.ws, lambda x: chr((1 + list_position(list_sort(list_distinct(tpl.ws)), x))::int)), '')) as edits
  from cand join d using (doc_id) join tpl using (label)),
fit as (select *, 1 - edits / longer as similarity, longer - 2 * edits as worth from span where 1 - edits / longer >= {LEAST_SIMILARITY}),
ok as (
  select * from fit a where not exists (
    select 1 from fit b where b.doc_id = a.doc_id and b.worth > a.worth and 2 * (least(a.hi, b.hi) - greatest(a.lo, b.lo)) >= a.hi - a.lo)),
c as (select doc_id, max(similarity) as coverage from ok group by doc_id),
bl as (select doc_id, string_agg(label, ',' order by label) as labels from (select distinct doc_id, label from base) group by doc_id),
al as (select doc_id, string_agg(label, ',' order by label) as labels from (select doc_id, label from base union select doc_id, label from ok) group by doc_id)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word,
  coalesce(bl.labels, '') as base_labels, coalesce(al.labels, '') as labels, greatest(case when b.n > 0 then 1.0::double else 0.0::double end, coalesce(c.coverage, 0))::double as score
from d left join b using (doc_id) left join bl using (doc_id) left join al using (doc_id) left join c using (doc_id)
"""


OP8_SQL = _sql()
