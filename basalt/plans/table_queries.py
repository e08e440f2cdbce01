"""Readers, nested rows, targets, pooling and roll-ups over the driver's tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import sequence as seq
from basalt.functions import vectors as vec
from basalt.operators import embed, intervals, jobs, metrics, nested, pooling, probes, splits
from basalt.plans import standins as st
from basalt.plans import tasks
from basalt.plans.queries import SQL, _rounded, _sql_cosine, _sql_ranking, context_windows, query
from basalt.sources import genomes, records, tables

@query(f"""with {st.SQL_INTERVALS}, x as (select contig_name, lead(s) over (partition by contig_name order by s, e) - e as gap from iv)
select contig_name, count(gap) as n_gaps, sum(gap)::bigint as total, min(gap)::bigint as least from x group by 1""")
def gene_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = st.intervals(spark, sf_dir).withColumn("gene_idx", F.struct("start", "end"))
    return intervals.gene_gaps(g, ["contig_name"], "gene_idx").groupBy("contig_name").agg(F.count("gap").alias("n_gaps"), F.sum("gap").alias("total"), F.min("gap").alias("least"))


@query(f"""with {st.SQL_LETTERS}, c as (select 'doc_' || doc_id as contig_name, s, len(s) as n from d),
g as (select contig_name, unnest(range(0, (n - 60) // 40 + 1)) as i from c where n >= 60), iv as (select contig_name, 11 + 40 * i as a, 35 + 40 * i + 10 * (i % 3) as b, case when i % 2 = 0 then 1 else -1 end as strand from g),
gaps as (select contig_name, coalesce(max(b) over (partition by contig_name order by a, b rows between unbounded preceding and 1 preceding), 0) + 1 as a, a - 1 as b from iv
  union all select contig_name, coalesce(max(iv.b), 0) + 1, max(n) from c left join iv using (contig_name) group by contig_name),
every as (select contig_name, a, b, strand, 'cds' as t from iv union all select contig_name, a, b, 0, 'intergenic' from gaps where a <= b)
select contig_name, a::bigint as start, b::bigint as "end", strand::int as strand, t as sequence_type, sha256(upper(substring(s, a, b - a + 1))) as sequence from every join c using (contig_name)""")
def q11_interval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as GFF and FASTA, read back, merged to the table of genes and gaps with their letters."""
    d = st.letters(spark, sf_dir).withColumn("c", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    gff, fna = tables.scratch(spark, "gff"), tables.scratch(spark, "fna")
    g = d.filter("length(s) >= 60").select("c", F.explode(F.sequence(F.lit(0), F.expr("int((length(s) - 60) div 40)"))).alias("i"))
    line = F.concat_ws("\t", "c", F.lit("x"), F.lit("CDS"), 11 + 40 * F.col("i"), 35 + 40 * F.col("i") + 10 * (F.col("i") % 3), F.lit("."), F.when(F.col("i") % 2 == 0, "+").otherwise("-"), F.lit("0"), F.concat(F.lit("locus_tag=L"), F.col("i").cast("string")))
    g.select(line.alias("value")).write.text(gff)
    d.select(F.concat(F.lit(">"), "c", F.lit("\n"), F.regexp_replace("s", "(.{70})", "$1\n")).alias("value")).write.text(fna)
    table = intervals.interval_table(genomes.read_genomes(spark, gff, "gff"), genomes.read_genomes(spark, fna, "fna"))
    return table.withColumns({"sequence": F.sha2("sequence", 256), "strand": F.col("strand").cast("int")})


@query(f"""with {st.SQL_LETTERS}, c as (select doc_id, s, len(s) as n from d), k as (select *, 1 as k from c where n >= 1 union all select *, 2 from c where n >= 60)
select 'acc_' || doc_id as accession_id, 'doc_' || doc_id || '.1' as contig_name, 'g' || k as gene_name, case k when 1 then 1 else 31 end::bigint as start1, case k when 1 then least(30, n) else n end::bigint as end1,
  case k when 1 then 1 else -1 end as strand, sha256(upper(substring(s, k, 30))) as protein from k""")
def q11_genbank_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as GenBank records of two coding regions, the second joined on the other strand, and read back; short
    ones have one, empty ones none."""
    d = st.letters(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    path = tables.scratch(spark, "gbff")
    head = F.concat(F.lit("LOCUS       doc_"), "id", F.lit("\nACCESSION   acc_"), "id", F.lit("\nVERSION     doc_"), "id", F.lit(".1\n  ORGANISM  Species one\nFEATURES             Location/Qualifiers\n"))
    cds = lambda name, place, at: F.concat(F.lit("     CDS             "), place, F.lit(f'\n                     /gene="{name}"\n                     /translation="'), F.upper(F.substring("s", at, 20)), F.lit("\n                     "), F.upper(F.substring("s", at + 20, 10)), F.lit('"\n'))
    n = F.length("s")
    first = F.concat(F.lit("1.."), F.least(n, F.lit(30)).cast("string"))
    second = F.concat(F.lit("complement(join(31..40,45.."), F.length("s").cast("string"), F.lit("))"))
    both = F.concat(F.when(n >= 1, cds("g1", first, 1)).otherwise(""), F.when(n >= 60, cds("g2", second, 2)).otherwise(""))
    d.select(F.concat(head, both, F.lit("ORIGIN\n//")).alias("value")).write.text(path)
    found = genomes.read_genomes(spark, path, "gbff")
    return found.select("accession_id", "contig_name", "gene_name", "start1", "end1", F.col("strand").cast("int").alias("strand"), F.sha2("protein_sequence", 256).alias("protein"))


@query(f"""with {st.SQL_LETTERS} select 'doc_' || doc_id || '.1' as contig_name, len(s)::bigint as length, sha256(s) as dna, case when len(s) >= 1 then sha256(upper(substring(s, 1, 30))) end as protein, (len(s) >= 1)::int::bigint as n_genes from d""")
def q11_record_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as FASTA and as GenBank files, read by byte ranges of 256 KB, contigs joined with their genes."""
    d = st.letters(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    fna, gbff = tables.scratch(spark, "fna"), tables.scratch(spark, "gbff")
    d.select(F.concat(F.lit(">doc_"), "id", F.lit(".1 letters\n"), F.regexp_replace("s", "(.{70})", "$1\n")).alias("value")).write.text(fna)
    gene = F.concat(F.lit('     CDS             1..3\n                     /translation="'), F.upper(F.substring("s", 1, 30)), F.lit('"\n'))
    head = F.concat(F.lit("LOCUS       doc_"), "id", F.lit("\nACCESSION   acc_"), "id", F.lit("\nVERSION     doc_"), "id", F.lit(".1\nFEATURES             Location/Qualifiers\n"))
    d.select(F.concat(head, F.when(F.length("s") >= 1, gene).otherwise(""), F.lit("ORIGIN\n        1 "), "s", F.lit("\n//")).alias("value")).write.text(gbff)
    contigs = genomes.contigs_of(records.genome_records(spark, fna, 1 << 18, "fna"))
    genes = genomes.cds_of(records.genome_records(spark, gbff, 1 << 18, "gbff")).groupBy("contig_name").agg(F.count("*").alias("n_genes"), F.min(F.sha2("protein_sequence", 256)).alias("protein"))
    return contigs.join(genes, "contig_name", "left").select("contig_name", "length", F.sha2("dna_sequence", 256).alias("dna"), "protein", F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


@query("""with r as (select o_custkey, 'f_' || o_orderkey as path, row_number() over (partition by o_custkey order by o_orderdate desc, 'f_' || o_orderkey desc) as r from orders)
select o_custkey, path from r where r = 1""")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = st.table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("f_"), F.col("o_orderkey").cast("string")))
    return genomes.newest_files(files, "o_custkey", "path", "o_orderdate")


@query("""with l as (select o_custkey, l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as parts, list(case when l_returnflag = 'R' then -1.0 else 1.0 end order by l_linenumber, case when l_returnflag = 'R' then -1.0 else 1.0 end) as strands from lineitem join orders on l_orderkey = o_orderkey group by all),
c as (select *, row_number() over (partition by o_custkey order by l_orderkey) - 1 as i from l)
select o_custkey, i::int as contig_idx, 'contig_' || i as contig, len(parts)::int as n_genes, parts[1] as first_part, parts[len(parts)] as last_part,
  array_to_string(list_transform(strands || list_transform(range(0, greatest(8 - len(strands), 0)), lambda x: -1.0), lambda x: x::int), ' ') as strands from c""")
def nested_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as genomes, orders as contigs, lines as genes: gathered to nested rows, exploded to contigs again, looked up by place."""
    lines = st.table(spark, sf_dir, "lineitem").join(st.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    lines = lines.withColumn("strand", F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0))
    key = ["o_custkey", "l_orderkey"]
    contigs = nested.gather(lines, key, "l_linenumber", "l_partkey", "parts").join(nested.gather(lines, key, "l_linenumber", "strand", "strands"), key)
    rows = contigs.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "parts", "strands"))).alias("c"))
    rows = rows.select("o_custkey", F.col("c.parts").alias("parts"), F.col("c.strands").alias("strands"), nested.contig_names(F.size("c")).alias("contig"))
    n = F.size("parts")
    ends = nested.pick(F.col("parts"), F.array(F.lit(0), n - 1))
    strands = F.array_join(F.transform(nested.padded(F.col("strands"), F.lit(8), F.lit(-1.0)), lambda x: x.cast("int").cast("string")), " ")
    return nested.explode_contigs(rows, ["parts", "strands", "contig"]).select("o_custkey", "contig_idx", "contig", n.alias("n_genes"), ends[0].alias("first_part"), ends[1].alias("last_part"), strands.alias("strands"))


@query("select doc_id, n_chars from documents order by doc_id limit 100 offset 37")
def row_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 37 to 136 by doc_id; the slice is the feature."""
    return nested.row_slice(st.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 37, 137)


@query("""with l as (select doc_id, toxic, case doc_id % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split from labels)
select l.doc_id, split, toxic, source from l join documents using (doc_id)""")
def checked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as Yes and No through a CSV file and splits, joined to documents with their number kept."""
    path = tables.scratch(spark, "labels")
    part = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test")
    tables.write_csv(st.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("toxic"), part.alias("split")), path)
    rows = tables.read_labels(spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))
    both = tables.union_splits(**{s: nested.one_split(rows, s).drop("split") for s in ("train", "validation", "test")})
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "source")
    return nested.inner_checked(both, docs, "doc_id").withColumn("toxic", nested.yes_no(F.col("toxic")))


_TARGETS = """w as (select doc_id, quality::varchar as quality, lang, case when toxic = 1 then 'pos' else 'zero' end as sign from labels join documents using (doc_id)),
long as (select doc_id, 'quality' as target, quality as value from w union all select doc_id, 'lang', lang from w union all select doc_id, 'sign', sign from w),
kept as (select * from long where value is not null qualify count(*) over (partition by target, value) >= 5)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = st.wide_labels(spark, sf_dir).withColumn("sign", F.when(F.col("toxic") == 1, "pos").otherwise("zero"))
    return splits.drop_rare_classes(splits.to_long(w, ["doc_id"], ["quality", "lang", "sign"]), 5)


@query(f"""with {_TARGETS}, r as (select *, dense_rank() over (partition by target order by value) - 1 as c from kept)
select target, value, case when target = 'sign' then (value = 'pos')::int else c::int end as class, count(*) as n from r group by all""")
def trait_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.trait_classes(_targets(spark, sf_dir)).groupBy("target", "value", F.col("class").cast("int").alias("class")).agg(F.count("*").alias("n"))


@query(f"""with {_TARGETS}, u as (select target, ('0x' || substring(md5('3:' || doc_id), 1, 13))::bigint / 4503599627370496.0 as u from kept)
select target, count(*) filter (u < 0.7) as n_train, count(*) filter (u >= 0.7 and u < 0.7 + 0.1) as n_validation, count(*) filter (u >= 0.7 + 0.1) as n_test from u group by 1""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_sizes(splits.plain_split(_targets(spark, sf_dir), "doc_id", 3), ["target"])


@query("""with x as (select source as target, count(*) as rows, count(distinct n_chars) as values from documents group by 1) select * from x where rows >= 8 and values > 1""")
def regression_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.usable_regression_targets(st.table(spark, sf_dir, "documents").select(F.col("source").alias("target"), F.col("n_chars").alias("value")), 8)


@query(f"""with p as (select source, doc_id % 3 as y, [(n_chars % 7 + 1)::double, (n_chars % 5 + 1)::double, (n_chars % 11 + 1)::double] as p from documents),
c as (select source, y, unnest(p) as s, unnest([0, 1, 2]) as c from p), l as (select source, c, s, (y = c)::int as label from c), {_sql_ranking("l", "source, c", "label", "s")}
select source, round(avg(auroc), 6) as macro_auroc, round(avg(auprc), 6) as macro_auprc from rk group by source""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.array(*((F.col("n_chars") % m + 1).cast("double") for m in (7, 5, 11)))
    rows = st.table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).alias("y"), share.alias("p"))
    return _rounded(metrics.macro_ranking(rows, ["source"], "y", "p"), "macro_auroc", "macro_auprc")


@query("""with x as (select source, (doc_id % 2)::double as y, (n_chars % 21 - 10) / 3.0 as z, (doc_id % 3)::int as c, [(n_chars % 7)::double, (n_chars % 5)::double, (n_chars % 11)::double] as l from documents)
select source, round(avg(case when y = 1 then 2 * ln(1 + exp(-z)) else ln(1 + exp(z)) end), 6) as bce, round(avg(ln(list_sum(list_transform(l, lambda v: exp(v)))) - l[c + 1]), 6) as ce from x group by 1""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("n_chars"), F.col("doc_id")
    logits = F.array(*((n % m).cast("double") for m in (7, 5, 11)))
    bce = metrics.log_loss((i % 2).cast("double"), (n % 21 - 10) / 3.0, 2.0)
    found = st.table(spark, sf_dir, "documents").groupBy("source").agg(F.avg(bce).alias("bce"), F.avg(metrics.cross_entropy((i % 3).cast("int"), logits)).alias("ce"))
    return _rounded(found, "bce", "ce")


@query(f"""with x as (select source, lang, toxic, n_chars % 100 as s from labels join documents using (doc_id)), {_sql_ranking("x", "source, lang", "toxic", "s")}
select 'g' || (len(source) % 3) as "group", round(avg(auroc), 6) as auroc, round(avg(auprc), 6) as auprc, count(*) as n from rk where auroc is not null and source is not null group by 1""")
def trait_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by target and seed averaged over the groups that a CSV table gives the targets."""
    x = st.wide_labels(spark, sf_dir).withColumn("s", F.col("n_chars") % 100)
    results = metrics.ranking(x, ["source", "lang"], "toxic", "s").withColumnRenamed("source", "target").withColumn("skipped", F.lit(None).cast("string"))
    path = tables.scratch(spark, "groups")
    named = x.select(F.concat(F.lit("g"), (F.length("source") % 3).cast("string")).alias("group"), F.col("source").alias("phenotype")).filter("phenotype is not null").distinct()
    tables.write_csv(named, path)
    return _rounded(probes.group_rollup(results, tables.trait_groups(spark, path), "auroc", ["auroc", "auprc"]), "auroc", "auprc")


@query("""with t as (select vec_id // 16 as batch, vec_id % 16 as i, (label % 4 <> 0)::int as mask, label % 2 as gene, unnest(embedding::double[]) as x, unnest(range(0, len(embedding))) as pos from embeddings),
r as (select batch, 'ragged_' || case when i < 5 then 0 when i < 9 then 2 else 3 end as kind, pos, avg(x) as x from t group by all),
u as (select batch, 'masked' as kind, pos, avg(x) as x from t where mask = 1 group by all union all select batch, 'gene', pos, sum(x * gene) / count(*) from t group by all
  union all select batch, 'first', pos, x from t where i = 0 union all select batch, 'end', pos, x from t where i = 15 union all select * from r)
select batch, kind, pos::int as pos, round(x, 6) as x from u""")
def token_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as tokens of batches of 16: masked, gene-masked, first-token, end-token and ragged pooling."""
    t = st.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("batch"), (F.col("vec_id") % 16).alias("i"), (F.col("label") % 4 != 0).cast("int").alias("mask"), (F.col("label") % 2).alias("gene"), F.lit(1).alias("one"), F.col("embedding").cast("array<double>").alias("v"))
    spans = t.select("batch").distinct().select("batch", F.posexplode(F.array(*(F.lit(n) for n in (5, 0, 4, 7)))).alias("seq", "length"))
    found = {"masked": pooling.masked_mean(t, ["batch"], "v", "mask"), "gene": pooling.gene_masked_mean(t, ["batch"], "v", "gene", "one"), "first": pooling.first_token(t, ["batch"], "v", "i"), "end": pooling.end_token(t, ["batch"], "v", "i", 15)}
    out = pooling.ragged_mean(t, spans, "batch", "i", "v").select("batch", F.concat(F.lit("ragged_"), F.col("seq").cast("string")).alias("kind"), "v")
    for kind, df in found.items():
        out = out.unionByName(df.select("batch", F.lit(kind).alias("kind"), "v"))
    return _rounded(out.select("batch", "kind", F.posexplode("v").alias("pos", "x")), "x")


@query(f"""with w as ({SQL["context_windows"]}), m as (select doc_id, substring(sequence, mask_start + 1, mask_length) as s from w)
select doc_id, pos::int as pos, round((len(s) - len(replace(s, letter, ''))) / 120.0, 6) as x from m, (values (0, 'A'), (1, 'C'), (2, 'G'), (3, 'T')) v(pos, letter)""")
def genes_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes embedded amid their neighbours: token vectors summed over the gene, divided by all tokens."""
    found = embed.embed_masked(context_windows(spark, sf_dir), "sequence")
    return _rounded(found.select("doc_id", F.posexplode("embedding").alias("pos", "x")), "x")


@query(f"""with {st.SQL_LETTERS}, g as (select doc_id, unnest(range(0, (len(s) - 60) // 40 + 1)) as i, s from d where len(s) >= 60),
p as (select doc_id, i, upper(substring(s, 11 + 40 * i, 25)) as p from g)
select doc_id // 8 as strain, count(distinct doc_id)::int as n_contigs, count(*)::int as n_genes, round(sum(len(p) - len(replace(p, letter, ''))) / 128.0, 6) as total, letter
from (select *, unnest(['A', 'C', 'G', 'T']) as letter from p) group by strain, letter""")
def genes_in_mixed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins amid the mixed text of their contigs, vectors regrouped by strain and summed there; tests hold the windows against
    plain Python."""
    d = st.letters(spark, sf_dir)
    strand = F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    places = F.sequence(F.lit(0), F.expr("int((length(s) - 60) div 40)"))
    proteins = vec.bound(F.col("s").cast("binary"), lambda s: F.transform(places, lambda i: seq.slice_dna(s, 11 + 40 * i, F.lit(25))))
    genes = d.filter("length(s) >= 60").select("doc_id", F.posexplode(proteins).alias("i", "protein_sequence"))
    genes = genes.select("doc_id", F.col("i").alias("gene_idx"), (11 + 40 * F.col("i")).alias("start"), (35 + 40 * F.col("i")).alias("end"), strand.alias("strand"), "protein_sequence")
    contigs = d.select("doc_id", F.expr("doc_id div 8").alias("strain"), F.col("s").alias("dna_sequence"))
    vectors = jobs.genes_in_mixed(genes, contigs, "doc_id", 128)
    strains = jobs.by_strain(contigs, vectors, "strain", "doc_id")
    every = F.flatten("embeddings")
    total = lambda i: F.aggregate(every, F.lit(0.0), lambda a, v: a + F.get(v, F.lit(i)))
    sums = F.array(*(F.struct(F.lit(x).alias("letter"), total(i).alias("total")) for i, x in enumerate("ACGT")))
    return _rounded(strains.select("strain", F.size("contigs").alias("n_contigs"), F.size(every).alias("n_genes"), F.inline(sums)), "total")


@query(f"""with {st.SQL_GENES}, p as (select a.contig, a.gene_idx, a.v as x, b.v as y, a.label from g a join g b on a.contig = b.contig and b.gene_idx = a.gene_idx + 1)
select contig, gene_idx, round(list_distance(x, y), 6) as distance, round((x[1] + y[1]) / 2, 6) as mean_first, (label % 4)::int as hot from p""")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring genes: Euclidean distance, mean of the pair, one-hot class."""
    g = st.genes(spark, sf_dir)
    pairs = g.select("contig", "gene_idx", "label", F.col("v").alias("x")).join(g.select("contig", (F.col("gene_idx") - 1).alias("gene_idx"), F.col("v").alias("y")), ["contig", "gene_idx"])
    hot = vec.argmax(vec.one_hot(F.col("label") % 4, 4))
    return _rounded(pairs.select("contig", "gene_idx", vec.euclidean(F.col("x"), F.col("y")).alias("distance"), F.get(vec.pair_mean(F.col("x"), F.col("y")), F.lit(0)).alias("mean_first"), hot.cast("int").alias("hot")), "distance", "mean_first")


@query(f"""with {st.SQL_GENES}, {st.SQL_EDGES}, sc as (select contig, (score >= 300)::int as label, {_sql_cosine("x", "y")} as s from e where i < 20 and j < 20), {_sql_ranking("sc", "contig", "label", "s")}
select contig, round(auroc, 6) as auroc, round(auprc, 6) as auprc, n as n_ppi_pairs, n_pos as n_pos_triples from rk""")
def q4_ppi_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the first 20 proteins of a genome; the bound is the feature."""
    g = st.genes(spark, sf_dir)
    return _rounded(tasks.ppi_zero_shot(g, st.edges(g), "contig", 0.3, most_proteins=20).drop("n_proteins"), "auroc", "auprc")
