"""Queries of text formats, annotation, genotypes, evaluation and other choices of seeds, with SQL that gives the same rows.

Text rows are made from the driver's tables and read back by the library's parsers; their SQL starts from the tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchlark import catalog
from sketchlark.catalog import _BUCKETS, _LINES, _MERGED, _SEEDS, _WINDOWS, DRIVER, index, line_intervals, ordered_seeds, query, read_kmers, reads, ref_kmers, table
from sketchlark.operators import annotation, assembly, evaluation, formats, mapping, sweeps, variants, views
from sketchlark.sources import tables as text


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)).alias("value")


def _gtf(spark, sf_dir) -> DataFrame:
    """Exon rows of the line items, a transcript an order, and a CDS row for each order's first line."""
    rows = table(spark, sf_dir, "lineitem").withColumn("feature", F.explode(F.when(F.col("l_linenumber") == 1, F.array(F.lit("exon"), F.lit("CDS"))).otherwise(F.array(F.lit("exon")))))
    start = F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")
    key = F.col("l_orderkey")
    kind = F.element_at(F.array(F.lit("mRNA"), F.lit("snRNA"), F.lit("other")), (key % 3 + 1).cast("int"))
    attrs = F.concat(F.lit('transcript_id "T'), key, F.lit('"; transcript_type "'), kind, F.lit('"; gene_name "G'), key % 100, F.lit('"; tag "basic";'))
    return rows.select(tabbed(F.concat(F.lit("chr"), key % 5), F.lit("s"), "feature", start + 1, start + F.col("l_quantity").cast("long"), F.lit("."), F.when(key % 2 == 1, "-").otherwise("+"), F.lit("."), attrs))


_EXONS = """exons AS (SELECT l_orderkey AS id, 'chr' || l_orderkey % 5 AS chrom, CASE WHEN l_orderkey % 2 = 1 THEN '-' ELSE '+' END AS strand, ['mRNA', 'snRNA', 'other'][l_orderkey % 3 + 1] AS kind, l_linenumber AS line,
  l_linenumber::BIGINT * 1000000 + l_partkey AS st, l_linenumber::BIGINT * 1000000 + l_partkey + l_quantity::BIGINT AS en FROM lineitem)"""
_NAME = "'T' || id || '|' || kind || '|G' || id % 100"


@query(f"""WITH {_EXONS}, t AS (SELECT id, chrom, strand, kind, min(st) AS st, max(en) AS en, min(st) FILTER (line = 1) AS c0, max(en) FILTER (line = 1) AS c1, list((st, en) ORDER BY st, en) AS x FROM exons GROUP BY id, chrom, strand, kind)
SELECT chrom, st, en, {_NAME} AS name, 1000 AS score, strand, coalesce(c0, st) AS thick_st, coalesce(c1, en) AS thick_en, CASE kind WHEN 'mRNA' THEN '0,128,255' WHEN 'snRNA' THEN '0,192,0' ELSE '196,196,196' END AS color, len(x)::INTEGER AS n_blocks,
  array_to_string([y[2] - y[1] FOR y IN x], ',') || ',' AS sizes, array_to_string([y[1] - st FOR y IN x], ',') || ',' AS starts FROM t""")
def gff_transcripts(spark, sf_dir):
    return annotation.transcripts_bed12(annotation.transcript_parts(text.parse_gff(_gtf(spark, sf_dir)), tag="basic"))


@query(f"WITH {_EXONS}, n AS (SELECT *, lag(en) OVER (PARTITION BY id ORDER BY st, en) AS before FROM exons) SELECT chrom, before AS st, st AS en, {_NAME} AS name, 1000 AS score, strand FROM n WHERE before IS NOT NULL")
def gff_introns(spark, sf_dir):
    return annotation.transcript_introns(annotation.transcript_parts(text.parse_gff(_gtf(spark, sf_dir))))


@query("SELECT 'c' || p_size AS chrom, p_partkey * 10 AS st, p_partkey * 10 + p_size::BIGINT AS en, 'G' || p_partkey || '|' || p_type || '|' || CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE p_name END AS name, 1000 AS score, '+' AS strand FROM part")
def gff_genes(spark, sf_dir):
    attrs = F.concat(F.lit("ID=x;gene_id=G"), "p_partkey", F.lit(";gene_biotype="), "p_type", F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit(";gene_name="), "p_name")))
    rows = table(spark, sf_dir, "part").select(tabbed(F.concat(F.lit("c"), "p_size"), F.lit("s"), F.lit("gene"), F.col("p_partkey") * 10 + 1, F.col("p_partkey") * 10 + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), attrs))
    return annotation.genes_bed(text.parse_gff(rows))


@query("SELECT 'chrUn_KI' || p_partkey || 'v1' AS chrom, p_partkey AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'chr1_GL' || p_partkey || 'v2_random', p_partkey FROM part WHERE p_size % 2 = 1")
def renamed_chroms(spark, sf_dir):
    """Accessions with the browser's names: scaffolds are known, unplaced ones made up."""
    rows = table(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    own = rows.select(F.when(even, F.concat(F.lit("KI"), "p_partkey", F.lit(".1"))).otherwise(F.concat(F.lit("GL"), "p_partkey", F.lit(".2"))).alias("chrom"), F.col("p_partkey").alias("n"))
    known = rows.where(~even).select(F.concat(F.lit("chr1_GL"), "p_partkey", F.lit("v2_random")).alias("name"))
    return annotation.renamed(own, known)


def _cigar(rows: DataFrame) -> DataFrame:
    """Spliced alignments of the parts: two exons of p_size + 5 and p_size letters, with gaps of 2 and p_size % 9 + 1 in the second."""
    cigar = F.concat(F.col("p_size") + 5, F.lit("M"), F.col("p_partkey") % 50 + 20, F.lit("N"), "p_size", F.lit("M2I"), F.col("p_size") % 9 + 1, F.lit("D4M"))
    return rows.select(F.col("p_partkey").alias("aln_id"), F.col("p_name").alias("query_id"), F.lit("s").alias("segm_name"), (F.col("p_partkey") * 100).alias("T_l"), F.when(F.col("p_size") % 2 == 1, "-").otherwise("+").alias("strand"), F.col("p_size").alias("score"), (F.col("p_size") % 5 != 0).alias("is_primary"), cigar.alias("cigar"))


_CIGAR = "al AS (SELECT p_partkey AS aln_id, p_name AS query_id, p_partkey * 100 AS t, CASE WHEN p_size % 2 = 1 THEN '-' ELSE '+' END AS strand, p_size AS score, p_size % 5 <> 0 AS is_primary, p_size + 5 AS a, p_partkey % 50 + 20 AS n, p_size + p_size % 9 + 5 AS b, p_size AS s FROM part)"


@query(f"WITH {_CIGAR} SELECT 's' AS chrom, t AS st, t + a + n + b AS en, query_id AS name, score, strand, t AS thick_st, t + a + n + b AS thick_en, CASE WHEN is_primary THEN '0,128,255' ELSE '196,196,196' END AS color, 2 AS n_blocks, a || ',' || b || ',' AS sizes, '0,' || (a + n) || ',' AS starts FROM al")
def splice_blocks(spark, sf_dir):
    out = annotation.spliced_bed12(_cigar(table(spark, sf_dir, "part")), keep_secondary=True)
    return out.withColumns({c: F.col(c).cast("long") for c in ("en", "thick_en")})


@query(f"""WITH {_CIGAR} SELECT aln_id, 'I' AS op, 2 AS n, (t + a + n + s)::BIGINT AS t_at FROM al WHERE 2 >= 3 UNION ALL SELECT aln_id, 'D', (s % 9 + 1)::INTEGER, (t + a + n + s)::BIGINT FROM al WHERE s % 9 + 1 >= 3""")
def long_gaps(spark, sf_dir):
    out = assembly.long_gaps(_cigar(table(spark, sf_dir, "part")).withColumn("P_start", F.lit(0)), 3)
    return out.select("aln_id", "op", "n", F.col("t_at").cast("long").alias("t_at"))


@query(f"WITH {_CIGAR} SELECT query_id, sum(s + 5 + s + 4)::BIGINT AS aligned, sum(s % 3)::BIGINT AS substitutions, sum(2)::BIGINT AS inserted, sum(s % 9 + 1)::BIGINT AS deleted, round(sum(s % 3 + 2 + s % 9 + 1)::DOUBLE / sum(s + 5 + s + 4 + 2 + s % 9 + 1), 6) AS error FROM al GROUP BY query_id")
def read_errors(spark, sf_dir):
    rows = _cigar(table(spark, sf_dir, "part")).withColumns({"nm": F.col("score") % 3 + 2 + F.col("score") % 9 + 1, "nn": F.lit(0)})
    return assembly.read_errors(rows).withColumn("error", F.round("error", 6))


@query(f"""WITH {_CIGAR}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY aln_id) AS hit, t + a + n + s + 4 + s % 9 + 1 AS t_r FROM al), nm AS (SELECT *, 'transcript_id=' || query_id || '#' || hit || ';transcript_type=protein_coding' AS name FROM w)
SELECT aln_id, 0 AS n, concat_ws(chr(9), 's', 'paf2gff', 'transcript', t + 1, t_r, 7 * s, strand, '.', name || ';identity=' || printf('%.4f', s::DOUBLE / (s + 10)) || ';aa_start=0;aa_end=3') AS line FROM nm
UNION ALL SELECT aln_id, 1, concat_ws(chr(9), 's', 'paf2gff', 'CDS', t + 1, t + a, 0, strand, 0, name || ';frameshift=0') FROM nm
UNION ALL SELECT aln_id, 2, concat_ws(chr(9), 's', 'paf2gff', 'CDS', t + a + n + 1, t_r, 0, strand, 0, name || ';frameshift=0') FROM nm""")
def paf_gff_rows(spark, sf_dir):
    rows = _cigar(table(spark, sf_dir, "part"))
    size = F.col("score")
    end = F.col("T_l") + formats.cigar_length("cigar", "MDN")
    lines = rows.select("aln_id", tabbed("query_id", size + 8, F.lit(0), size + 5, "strand", "segm_name", F.lit(10**7), "T_l", end, size, size + 10, F.lit(60), F.concat(F.lit("AS:i:"), size * 7), F.concat(F.lit("cg:Z:"), "cigar")))
    return annotation.paf_gff(_parsed(lines))


def _parsed(lines: DataFrame) -> DataFrame:
    """The PAF rows (aln_id, the columns of ``formats.parse_paf``) of lines (aln_id, value)."""
    named = lines.select(F.concat_ws("\t", F.concat_ws("#", "aln_id", "value")).alias("value"))
    rows = formats.parse_paf(named)
    return rows.withColumns({"aln_id": F.substring_index("query_id", "#", 1).cast("long"), "query_id": F.expr("substring(query_id, instr(query_id, '#') + 1)")})


@query(f"""WITH {_LINES}, a AS (SELECT DISTINCT chrom, st, en FROM lines WHERE line = 2 AND st < en), p AS (SELECT * FROM lines WHERE line = 1),
j AS (SELECT p.id, p.chrom, p.st, p.en, count(a.st) AS met, coalesce(bool_or(abs(p.st - a.st) <= 10 AND abs(p.en - a.en) <= 10), false) AS hit FROM p LEFT JOIN a ON p.chrom = a.chrom AND p.st < a.en AND a.st < p.en GROUP BY ALL)
SELECT id, chrom, st, en, met, CASE WHEN hit THEN 'C' WHEN met > 0 THEN 'P' ELSE 'N' END AS verdict FROM j""")
def junction_verdicts(spark, sf_dir):
    rows = line_intervals(spark, sf_dir)
    found = rows.where("line = 1").select("id", "chrom", "st", "en").distinct()
    out = annotation.judged(found, rows.where("line = 2"), 60, tolerance=10)
    return out.select("id", "chrom", "st", "en", F.coalesce(F.size("met"), F.lit(0)).cast("long").alias("met"), "verdict")


@query(f"""WITH all_lines AS (SELECT * FROM (WITH {_LINES} SELECT * FROM lines)), x AS (SELECT DISTINCT chrom, st, en FROM all_lines WHERE line = 2 AND st < en), p AS (SELECT DISTINCT id, chrom, st, en FROM all_lines WHERE line = 1),
j AS (SELECT p.id, p.chrom, p.st, p.en, count(x.st) AS met, coalesce(bool_or(p.st = x.st AND p.en = x.en), false) AS hit FROM p LEFT JOIN x ON p.chrom = x.chrom AND p.st < x.en AND x.st < p.en GROUP BY ALL),
v AS (SELECT count(*) AS predicted, count(*) FILTER (met = 0) AS apart, count(*) FILTER (hit) AS correct FROM j),
a AS (WITH lines AS (SELECT * FROM all_lines WHERE line = 1 AND chrom IN (SELECT chrom FROM x)), {_MERGED} SELECT * FROM merged), b AS (WITH lines AS (SELECT * FROM all_lines WHERE line = 2), {_MERGED} SELECT * FROM merged),
c AS (SELECT (SELECT coalesce(sum(least(a.en, b.en) - greatest(a.st, b.st)), 0)::BIGINT FROM a JOIN b ON a.chrom = b.chrom AND a.st < b.en AND b.st < a.en) AS shared, (SELECT sum(en - st)::BIGINT FROM a) AS found, (SELECT sum(en - st)::BIGINT FROM b) AS wanted)
SELECT 'exons' AS measure, predicted AS n, correct AS right, round(100 * correct::DOUBLE / predicted, 2) AS percent FROM v UNION ALL SELECT 'sn', wanted, shared, round(100 * shared::DOUBLE / wanted, 2) FROM c UNION ALL SELECT 'sp', found, shared, round(100 * shared::DOUBLE / found, 2) FROM c""")
def exon_accuracy(spark, sf_dir):
    rows = line_intervals(spark, sf_dir)
    found, known = rows.where("line = 1").select("id", "chrom", "st", "en").distinct(), rows.where("line = 2")
    counts = annotation.verdict_counts(annotation.judged(found, known, 60)).select(F.lit("exons").alias("measure"), F.col("predicted").alias("n"), F.col("correct").alias("right"))
    base = annotation.base_accuracy(found, known, 60)
    out = counts.union(base.select(F.lit("sn"), "wanted", "shared")).union(base.select(F.lit("sp"), "found", "shared"))
    return out.withColumn("percent", F.round(100 * F.try_divide(F.col("right").cast("double"), "n"), 2))


_GENES = """al AS (SELECT (l_linenumber - 1) % 3 AS assembly, l_partkey AS g, 60 AS size, (l_suppkey % 4 * 15)::INTEGER AS a, least(60, (l_suppkey % 4 * 15)::INTEGER + l_quantity::INTEGER + 10) AS b, l_discount <= 0.08 AS good FROM lineitem)"""


@query(f"""WITH {_GENES}, o AS (SELECT *, greatest(b - greatest(a, coalesce(max(b) OVER (PARTITION BY assembly, g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS fresh FROM al WHERE good),
s AS (SELECT assembly, g, count(*) FILTER (b - a >= 0.7 * size) AS copies, sum(fresh)::DOUBLE / 60 AS covered FROM o GROUP BY assembly, g),
seen AS (SELECT DISTINCT assembly, g FROM al), have AS (SELECT seen.*, coalesce(copies, 0) AS copies, coalesce(covered, 0) AS covered FROM seen LEFT JOIN s USING (assembly, g)),
base AS (SELECT g, copies AS n FROM have WHERE assembly = 0 AND copies > 0), rows AS (SELECT base.g, base.n, y.assembly, h.copies, h.covered FROM base JOIN (VALUES (0), (1), (2)) y(assembly) ON true LEFT JOIN have h ON h.g = base.g AND h.assembly = y.assembly)
SELECT assembly, count(*) FILTER (n = 1 AND copies = 1) AS full_sgl, count(*) FILTER (n = 1 AND copies > 1) AS full_dup, count(*) FILTER (n = 1 AND copies = 0 AND covered >= 0.7) AS frag, count(*) FILTER (n = 1 AND copies = 0 AND covered >= 0.5 AND covered < 0.7) AS part50,
  count(*) FILTER (n = 1 AND copies = 0 AND covered >= 0.1 AND covered < 0.5) AS part10, count(*) FILTER (n = 1 AND (copies IS NULL OR copies = 0 AND covered < 0.1)) AS missing, count(*) FILTER (n > 1 AND copies > 1) AS dup_cnt, coalesce(sum(copies) FILTER (n > 1), 0)::BIGINT AS dup_sum FROM rows GROUP BY assembly""")
def gene_classes(spark, sf_dir):
    start = (F.col("l_suppkey") % 4 * 15).cast("int")
    end = F.least(F.lit(60), start + F.col("l_quantity").cast("int") + 10)
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_linenumber") - 1) % 3).alias("assembly"), F.col("l_partkey").alias("query_id"), F.lit(60).alias("P_sz"), start.alias("P_start"), end.alias("P_end"), F.when(F.col("l_discount") <= 0.08, 100).otherwise(10).alias("n_match"), F.lit(100).alias("blk_len"), F.lit("s").alias("segm_name"), (F.col("l_partkey") * 100).alias("T_l"), (F.col("l_partkey") * 100 + 60).alias("T_r"), F.col("l_orderkey").alias("at"))
    return annotation.gene_completeness(rows, min_cov=0.7)[1].withColumn("assembly", F.col("assembly").cast("int"))


_VCF = """v AS (SELECT p_partkey AS pos, CASE p_size % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN '7' WHEN 2 THEN 'Y' ELSE 'decoy' END AS chrom, p_brand AS ref, p_size % 5 AS a, p_size % 3 AS b, p_size AS d FROM part)"""


def _vcf(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    chrom = F.when(size % 4 == 0, "chrX").when(size % 4 == 1, "7").when(size % 4 == 2, "Y").otherwise("decoy")
    one = F.when(size % 5 == 0, "./.").when(size % 5 == 1, "0/1").otherwise("1/1")
    two = F.when(size % 3 == 0, "./.").when(size % 3 == 1, "0/0").otherwise("1/0")
    info = F.concat(F.lit("SVTYPE=DEL;SVLEN="), size, F.lit(";END="), F.col("p_partkey") + 9)
    alts = F.when(size % 7 == 0, "<DEL>").otherwise(F.concat_ws(",", F.split("p_type", " ")))
    return table(spark, sf_dir, "part").select(tabbed(chrom, "p_partkey", F.lit("."), "p_brand", alts, F.lit("9"), F.lit("PASS"), info, F.lit("GT:AD"), F.concat(one, F.lit(":"), size, F.lit(",3")), F.concat(two, F.lit(":2,"), size)))


@query(f"""WITH {_VCF}, f AS (SELECT *, CASE WHEN a = 0 THEN 'GAP1' WHEN a = 1 THEN 'HET1' END AS f1, CASE WHEN b = 0 THEN 'GAP2' WHEN b = 2 THEN 'HET2' END AS f2 FROM v WHERE chrom <> 'decoy')
SELECT chrom, pos, CASE WHEN f1 IS NULL AND f2 IS NULL OR f2 IS NULL AND f1 = 'GAP1' AND chrom = 'chrX' AND NOT (pos >= 0 AND pos + length(ref) <= 2699520) OR f1 IS NULL AND f2 = 'GAP2' AND chrom = 'Y' THEN '.' ELSE concat_ws(';', f1, f2) END AS filter,
  CASE WHEN f1 IS NULL THEN '1' ELSE '.' END || '|' || CASE WHEN f2 IS NULL THEN '0' ELSE '.' END || ':' || (d + 2) || ',' || (d + 3) AS genotype FROM f""")
def paired_vcf(spark, sf_dir):
    return annotation.paired_genotypes(text.parse_vcf(_vcf(spark, sf_dir)), male=True, version="37").select("chrom", "pos", "filter", "genotype")


@query("""SELECT p_partkey AS pos, CASE WHEN p_size % 7 = 0 THEN [-p_size::BIGINT] ELSE [(length(a) - length(p_brand))::BIGINT FOR a IN string_split(p_type, ' ')] END AS change FROM part""")
def vcf_changes(spark, sf_dir):
    return text.vcf_lengths(text.parse_vcf(_vcf(spark, sf_dir))).select("pos", "change")


@query("""SELECT 'c' || p_size AS chrom, p_partkey + 10 * i AS st, p_partkey + 10 * i + p_size AS en, p_name AS name FROM part, (VALUES (0), (1), (2)) t(i) WHERE p_size % 2 = 0
UNION ALL SELECT 'c' || p_size, p_partkey, p_partkey + 99, p_name FROM part WHERE p_size % 2 = 1""")
def bed_blocks(spark, sf_dir):
    size, at = F.col("p_size"), F.col("p_partkey")
    listed = F.concat(size, F.lit(","), size, F.lit(","), size, F.lit(","))
    long = tabbed(F.concat(F.lit("c"), size), at, at + 99, "p_name", F.lit(0), F.lit("+"), at, at, F.lit("0"), F.lit(3), listed, F.lit("0,10,20,"))
    rows = table(spark, sf_dir, "part").select(F.when(size % 2 == 0, long).otherwise(tabbed(F.concat(F.lit("c"), size), at, at + 99, "p_name")).alias("value"))
    return text.bed_intervals(text.parse_bed(rows))


@query("SELECT p_name || '.' || p_partkey AS name, p_size * 1000::BIGINT AS length FROM part")
def length_table(spark, sf_dir):
    return text.parse_lengths(table(spark, sf_dir, "part").select(tabbed(F.concat_ws(".", "p_name", "p_partkey"), F.col("p_size") * 1000, F.lit("x"))))


@query(f"""WITH {_CIGAR} SELECT aln_id, 0 AS n, concat_ws(' ', 'cigar:', query_id, 0, s + 11, strand, 's', t, t + a + n + b, '+', 7 * s, 'M', a, 'N', n, 'M', s, 'I', 2, 'D', s % 9 + 1, 'M', 4) AS line FROM al""")
def view_moves(spark, sf_dir):
    rows = _cigar(table(spark, sf_dir, "part"))
    end = F.col("T_l") + formats.cigar_length("cigar", "MDN")
    lines = rows.select("aln_id", tabbed("query_id", F.col("score") + 20, F.lit(0), F.col("score") + 11, "strand", "segm_name", F.lit(10**7), "T_l", end, F.lit(1), F.lit(1), F.lit(60), F.concat(F.lit("AS:i:"), F.col("score") * 7), F.concat(F.lit("cg:Z:"), "cigar")))
    return views.view(_parsed(lines), "moves")


@query("""SELECT p_partkey AS aln_id, string_agg(line, chr(10) ORDER BY n) AS lines FROM (SELECT p_partkey, u.n, u.line FROM (SELECT p_partkey, p_size % 6 + 3 AS k, p_size % 2 = 1 AS minus, repeat('=', p_size % 6 + 3) AS e FROM part),
 LATERAL (VALUES (0, 'mm:i:1' || chr(9) || 'oi:i:1' || chr(9) || 'ei:i:2' || chr(9) || 'od:i:1' || chr(9) || 'ed:i:3'), (1, 'Ref+: ' || lpad('101', 10, ' ') || ' ' || e || 'a--ccc' || ' ' || rpad((100 + k + 4)::VARCHAR, 10, ' ')), (2, repeat(' ', 17) || repeat('|', k) || repeat(' ', 6)),
  (3, CASE WHEN minus THEN 'Qry-: ' || lpad((10 + k + 3)::VARCHAR, 10, ' ') || ' ' || e || 'ggt---' || ' ' || rpad('11', 10, ' ') ELSE 'Qry+: ' || lpad('11', 10, ' ') || ' ' || e || 'ggt---' || ' ' || rpad((10 + k + 3)::VARCHAR, 10, ' ') END), (4, '//')) u(n, line)) GROUP BY p_partkey""")
def view_pairs(spark, sf_dir):
    size = F.col("p_size") % 6 + 3
    strand = F.when(F.col("p_size") % 2 == 1, "-").otherwise("+")
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("aln_id"), tabbed("p_name", F.lit(99), F.lit(10), size + 13, strand, F.lit("s"), F.lit(999), F.lit(100), size + 104, F.lit(1), F.lit(1), F.lit(60), F.concat(F.lit("cs:Z::"), size, F.lit("*ag+gt-ccc"))))
    out = views.view(_parsed(lines)).withColumn("line", F.when(F.col("n") == 0, F.regexp_replace("line", r"^.*(mm:i:)", "$1")).otherwise(F.col("line")))
    return out.groupBy("aln_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n").alias("lines"))


_PAIRS = """mp AS (SELECT l_orderkey AS o, l_linenumber AS line, l_partkey AS part, 'r' || l_orderkey || '!s' || l_orderkey % 3 || '!100_300!160_360!+-/' || l_orderkey % 2 + 1 AS query_id, 's' || (l_orderkey + CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) % 3 AS segm_name,
  CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE 300 END + l_quantity::INTEGER AS l, CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE 300 END + l_quantity::INTEGER + l_linenumber * 8 + 20 AS r, (l_partkey % 61)::INTEGER AS mapq FROM lineitem),
tr AS (SELECT *, CASE WHEN o % 2 = 0 THEN 100 ELSE 300 END AS a, CASE WHEN o % 2 = 0 THEN 160 ELSE 360 END AS b FROM mp),
jd AS (SELECT *, NOT (segm_name = 's' || o % 3 AND greatest(0, least(r, b) - greatest(l, a))::DOUBLE / (greatest(r, b) - least(l, a)) > 0.1::DOUBLE) AS wrong FROM tr),
cp AS (SELECT * REPLACE (least(mapq, first_value(mapq) OVER (PARTITION BY query_id ORDER BY r - l DESC, segm_name, l, mapq)) AS mapq) FROM jd)"""


@query(f"WITH {_PAIRS} SELECT query_id, bool_or(wrong) AS wrong, CASE WHEN bool_or(wrong) THEN max(mapq) FILTER (wrong) ELSE max(mapq) END AS mapq FROM jd GROUP BY query_id")
def mapeval_pairs(spark, sf_dir):
    """Paired read names, all mappings of a read counted."""
    return evaluation.judged_reads(_pair_mappings(spark, sf_dir), mode="all").select("query_id", "wrong", "mapq")


def _pair_mappings(spark, sf_dir) -> DataFrame:
    odd = F.col("l_orderkey") % 2
    name = F.concat(F.lit("r"), "l_orderkey", F.lit("!s"), F.col("l_orderkey") % 3, F.lit("!100_300!160_360!+-/"), odd + 1)
    start = F.when(odd == 0, 100).otherwise(300) + F.col("l_quantity").cast("int")
    moved = F.when(F.col("l_discount") > 0.08, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(name.alias("query_id"), F.concat(F.lit("s"), (F.col("l_orderkey") + moved) % 3).alias("segm_name"), F.when(odd == 0, "+").otherwise("-").alias("strand"), start.alias("T_l"), (start + F.col("l_linenumber") * 8 + 20).alias("T_r"), (F.col("l_partkey") % 61).cast("int").alias("mapq"))


@query(f"WITH {_PAIRS} SELECT count(*) AS errors, sum(mapq)::BIGINT AS qualities FROM (SELECT query_id, max(mapq) FILTER (wrong) AS mapq FROM jd GROUP BY query_id) WHERE mapq >= 20")
def mapeval_errors(spark, sf_dir):
    return evaluation.error_rows(evaluation.judged_reads(_pair_mappings(spark, sf_dir), mode="all"), 20).agg(F.count("*").alias("errors"), F.sum("mapq").alias("qualities"))


@query("""SELECT 'o' || o_orderkey || '!c!' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey || '!' || (o_custkey + 8) || '!+' ELSE o_custkey || '_' || (o_custkey + 50) || '!' || (o_custkey + 8) || '_' || (o_custkey + 58) || '!+-/' || m END AS name, '1:2:3' AS comment,
 CASE WHEN m = 1 THEN 'ACGTACGG' ELSE 'CCGTACGT' END AS seq, CASE WHEN m = 1 THEN 'abcdefgh' ELSE 'hgfedcba' END AS qual FROM orders, (VALUES (1), (2)) t(m) WHERE m = 1 OR o_custkey % 3 <> 0""")
def simulated_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("m", F.explode(F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    flag = F.when(F.col("o_custkey") % 3 == 0, 0).when(F.col("m") == 1, 0x40).otherwise(0x90)
    return evaluation.simulated_pairs(rows.select(F.concat(F.lit("simulated.o"), "o_orderkey").alias("query_id"), flag.alias("flag"), F.lit("c").alias("segm_name"), (F.col("o_custkey") + (F.col("m") - 1) * 50).alias("pos"), F.lit("4M1I2D2M").alias("cigar"), F.lit("ACGTACGG").alias("seq"), F.lit("abcdefgh").alias("qual"), F.lit(1).alias("errors"), F.lit(2).alias("snps"), F.lit(3).alias("indels")))


@query(f"WITH {_SEEDS} SELECT query_id, h, rank FROM ranked WHERE rank <= 20")
def rarest_seeds(spark, sf_dir):
    return sweeps.rarest(ordered_seeds(spark, sf_dir), 20).select("query_id", "h", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SEEDS} SELECT query_id, h, row_number() OVER (PARTITION BY query_id ORDER BY hits, (h < 0), h) AS rank FROM ranked WHERE hits > 0")
def matching_seeds(spark, sf_dir):
    return sweeps.matching(ordered_seeds(spark, sf_dir)).select("query_id", "h", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SEEDS}, s AS (SELECT query_id, min(rank) AS stop FROM ranked WHERE before >= budget AND hits > 1 GROUP BY query_id) SELECT r.query_id, r.h, r.before < r.budget OR s.stop IS NULL OR r.rank < s.stop AS used FROM ranked r LEFT JOIN s ON r.query_id = s.query_id")
def extended_budget(spark, sf_dir):
    return sweeps.extended(ordered_seeds(spark, sf_dir)).select("query_id", "h", "used")


@query(f"WITH {_SEEDS} SELECT query_id, count(*) FILTER (before >= (1.0::DOUBLE - {DRIVER.theta!r}::DOUBLE) * m) AS frequent, count(*) AS seeds FROM ranked GROUP BY query_id")
def frequent_seeds(spark, sf_dir):
    return sweeps.split_by_frequency(ordered_seeds(spark, sf_dir), DRIVER.theta).groupBy("query_id").agg(F.count(F.when(F.col("frequent"), 1)).alias("frequent"), F.count("*").alias("seeds"))


@query(f"""WITH {_SEEDS}, fl AS (SELECT *, before >= (1.0::DOUBLE - {DRIVER.theta!r}::DOUBLE) * m AS frequent FROM ranked), hi AS (SELECT s.query_id, r.id AS segm_id, r.r, s.h, s.occs, s.m, s.frequent, length(q.seq) AS n FROM fl s JOIN ref r ON s.h = r.h JOIN qry_s q ON q.id = s.query_id),
ar AS (SELECT query_id, segm_id, r - n AS st, r + n + 1 AS en FROM hi WHERE NOT frequent),
mk AS (SELECT *, CASE WHEN max(en) OVER (PARTITION BY query_id, segm_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= st THEN 0 ELSE 1 END AS fresh FROM ar), il AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, segm_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM mk),
sp AS (SELECT query_id, segm_id, min(st) AS st, max(en) AS en FROM il GROUP BY query_id, segm_id, island),
pk AS (SELECT sp.query_id, sp.segm_id, sp.st, sp.en, hi.h, least(count(*), any_value(hi.occs)) AS n, any_value(hi.frequent) AS frequent, any_value(hi.m) AS m FROM sp JOIN hi ON sp.query_id = hi.query_id AND sp.segm_id = hi.segm_id AND hi.r >= sp.st AND hi.r < sp.en GROUP BY ALL),
sm AS (SELECT query_id, segm_id, st, en, coalesce(sum(n) FILTER (NOT frequent), 0)::BIGINT AS rare, sum(n)::BIGINT AS "all", any_value(m) AS m FROM pk GROUP BY query_id, segm_id, st, en), co AS (SELECT query_id, coalesce(sum(occs) FILTER (frequent), 0) AS c FROM fl GROUP BY query_id)
SELECT sm.query_id, segm_id, st::BIGINT AS st, en::BIGINT AS en, rare, "all" FROM sm JOIN co ON sm.query_id = co.query_id WHERE rare + c >= {DRIVER.theta!r}::DOUBLE * m""")
def promising_intervals(spark, sf_dir):
    sizes = reads(spark, sf_dir).select("query_id", F.length("seq").alias("P_sz"))
    ref = index(spark, sf_dir)
    split = sweeps.split_by_frequency(mapping.seeded(read_kmers(spark, sf_dir), ref, DRIVER)[0], DRIVER.theta)
    out = sweeps.promising_intervals(split, ref, sizes, DRIVER.theta, 2000)
    return out.select("query_id", "segm_id", F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"), F.col("rare").cast("long").alias("rare"), F.col("all").cast("long").alias("all"))


@query(f"WITH {_WINDOWS}, hi AS (SELECT s.query_id, r.id AS segm_id, r.r FROM seeds s JOIN ref r ON s.h = r.h) SELECT b.query_id, count(*) FILTER (hi.segm_id <> b.segm_id OR hi.r < b.T_l OR hi.r > b.T_r) AS spurious FROM best b JOIN hi ON b.query_id = hi.query_id GROUP BY b.query_id")
def spurious(spark, sf_dir):
    ref = index(spark, sf_dir)
    ordered, usable = mapping.seeded(read_kmers(spark, sf_dir), ref, DRIVER)
    hits = ordered.where("hits > 0").select("query_id", "h").join(usable, "h")
    return sweeps.spurious_matches(hits, mapping.map_seeds(ordered, usable, DRIVER))


@query(f"WITH {_WINDOWS} SELECT count(*) FILTER (score < 0.8) AS below, count(*) AS mappings, round((count(*) FILTER (score < 0.8))::DOUBLE / count(*), 9) AS share FROM best")
def low_scores(spark, sf_dir):
    return sweeps.share_below(catalog._mapped(spark, sf_dir), 0.8).withColumn("share", F.round("share", 9))


@query("WITH " + catalog._REF + ", n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id, r) AS n FROM ref) SELECT h, id AS segm_id, r FROM n WHERE n <= 4")
def capped_hits(spark, sf_dir):
    return sweeps.capped_index(ref_kmers(spark, sf_dir), 2).select("h", "segm_id", "r")


@query(f"WITH {_BUCKETS}, ask AS (SELECT DISTINCT query_id, segm_id, b * m AS lo, (b + 2) * m AS hi FROM buckets) SELECT a.query_id, a.segm_id, count(*) AS hits, sum(r.r)::BIGINT AS places FROM ask a JOIN seeds s ON s.query_id = a.query_id JOIN ref r ON r.id = a.segm_id AND r.h = s.h AND r.tpos >= a.lo AND r.tpos < a.hi GROUP BY a.query_id, a.segm_id")
def bucket_probes(spark, sf_dir):
    ref = index(spark, sf_dir)
    ordered, usable = mapping.seeded(read_kmers(spark, sf_dir), ref, DRIVER)
    spans = mapping.bucket_matches(ordered, usable, DRIVER).select("query_id", "segm_id", (F.col("b") * F.col("m")).alias("low"), ((F.col("b") + 2) * F.col("m")).alias("high")).distinct()
    asked = spans.join(ordered.where("hits > 0").select("query_id", "h"), "query_id")
    return sweeps.probe(ref, asked).groupBy("query_id", "segm_id").agg(F.count("*").alias("hits"), F.sum("r").alias("places"))


@query(f"""WITH {_LINES}, ends AS (SELECT chrom, st AS pos, 1 AS d FROM lines WHERE line > 1 AND st < en UNION ALL SELECT chrom, en, -1 FROM lines WHERE line > 1 AND st < en), steps AS (SELECT chrom, pos, sum(d) AS d FROM ends GROUP BY chrom, pos),
runs AS (SELECT chrom, pos AS st, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS en, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM steps)
SELECT q.id, q.st, q.en, coalesce(max(r.depth), 0)::BIGINT AS most FROM (SELECT DISTINCT chrom, st, en, id FROM lines WHERE line = 1) q LEFT JOIN runs r ON q.chrom = r.chrom AND q.st < r.en AND r.st < q.en AND r.depth > 0 GROUP BY q.chrom, q.id, q.st, q.en""")
def range_maxima(spark, sf_dir):
    rows = line_intervals(spark, sf_dir)
    asked = rows.where("line = 1").select("chrom", "st", "en", "id").distinct()
    return sweeps.range_maxima(rows.where("line > 1"), asked, 60).select("id", "st", "en", "most")


@query("SELECT l_orderkey AS o, l_linenumber AS at, l_partkey AS v, sum(l_partkey) OVER w::BIGINT AS prefix_sum, max(l_partkey) OVER w AS prefix_max FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING)")
def prefix_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("v"))
    return sweeps.prefix_values(rows, ["o"], "at", "v")


@query("""WITH m AS (SELECT l_orderkey AS query_id, l_suppkey % 2 AS segm_id, l_partkey AS t, l_quantity AS score, row_number() OVER () AS i FROM lineitem)
SELECT query_id, segm_id, t AS "T_l", score FROM (SELECT DISTINCT query_id, segm_id, t, score FROM m) a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.query_id = b.query_id AND a.segm_id = b.segm_id AND abs(a.t - b.t) < 500 AND (b.score > a.score OR b.score = a.score AND b.t < a.t))""")
def dominant_mappings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 2).alias("segm_id"), F.col("l_partkey").alias("T_l"), F.col("l_quantity").alias("score"), F.lit(500).alias("reach"))
    return sweeps.dominant(rows, "reach").drop("reach")


_GRID = [0.9, 0.65, 0.4]


def _budget_sql(theta: float) -> str:
    return f"SELECT {theta!r}::DOUBLE AS theta, sum(CASE WHEN before < floor((1.0::DOUBLE - ({theta!r}::DOUBLE - {DRIVER.min_diff!r}::DOUBLE)) * m)::INTEGER + 1 THEN 1 ELSE 0 END)::BIGINT AS used, count(*) AS seeds FROM ranked"


@query(f"WITH {_SEEDS} {' UNION ALL '.join(map(_budget_sql, _GRID))}")
def sweep_theta(spark, sf_dir):
    """The seeds within the budget at several thresholds."""
    ref = index(spark, sf_dir)

    def run(p):
        found = mapping.seed_order(mapping.seeds(read_kmers(spark, sf_dir, p), mapping.hit_counts(ref)), p)
        return found.agg(F.sum(F.col("used").cast("int")).alias("used"), F.count("*").alias("seeds"))

    return sweeps.sweep_parameters(run, sweeps.grid(DRIVER, theta=_GRID)).select("theta", "used", "seeds")


@query(f"SELECT {', '.join(f'{v!r} AS {chr(34)}{k}{chr(34)}' for k, v in replace(DRIVER, reads_file='reads.fa', ref_file='ref.fa').values().items())}")
def parameter_row(spark, sf_dir):
    return replace(DRIVER, reads_file="reads.fa", ref_file="ref.fa").row(spark)


@query("SELECT l_orderkey AS o, l_linenumber AS line, l_quantity >= 10 AND l_quantity < 20 AS inside, l_quantity + 5 >= l_tax * 100 AND l_tax * 100 + 30 >= l_quantity AND l_suppkey % 2 = l_partkey % 2 AS meets FROM lineitem")
def interval_predicates(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), catalog.S.point_in(q, F.lit(10), F.lit(20)).alias("inside"), catalog.S.intervals_meet(F.col("l_suppkey") % 2, q, q + 5, F.col("l_partkey") % 2, t, t + 30).alias("meets"))


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ABCDGHKMRTUVWY', 'TVGHCDMKYAABWR')) AS rc FROM part")
def iupac_revcomp(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", catalog.S.reverse_complement_iupac(F.upper("p_name")).alias("rc"))


@query("SELECT p_partkey, (p_size * 1000 + 500)::BIGINT AS n, round(abs(p_size - p_partkey % 7)::DOUBLE / sqrt((p_size + p_partkey % 7)::DOUBLE), 9) AS apart FROM part")
def numbers_and_deviations(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", catalog.S.suffixed_number(F.concat("p_size", F.lit(".5k"))).alias("n"), F.round(catalog.S.sigmas(F.col("p_size"), F.col("p_partkey") % 7), 9).alias("apart"))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS alt, CASE WHEN d > 0 THEN 'ins:' || c WHEN d < 0 THEN 'del:' || c ELSE 'mnp' END AS kind FROM (SELECT p_partkey, p_type, d, CASE WHEN abs(d) = 1 THEN '1' WHEN abs(d) = 2 THEN '2' ELSE '3-49' END AS c FROM (SELECT *, length(string_split(p_type, ' ')[1]) - length(p_brand) AS d FROM part))""")
def length_classes(spark, sf_dir):
    alt = F.split("p_type", " ")[0]
    return table(spark, sf_dir, "part").select("p_partkey", alt.alias("alt"), formats.variant_class(F.col("p_brand"), alt).alias("kind"))


@query(f"""WITH {_LINES}, x AS (SELECT DISTINCT chrom, st, en FROM lines WHERE line = 3), t AS (SELECT DISTINCT chrom, st, en, id FROM lines WHERE line = 1) SELECT t.id, t.chrom, t.st, t.en FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.chrom = t.chrom AND x.st < t.en AND t.st < x.en)""")
def bedcov_exclude(spark, sf_dir):
    rows = line_intervals(spark, sf_dir)
    targets = rows.where("line = 1").select("chrom", "st", "en", "id").distinct()
    named = targets.select("chrom", "st", "en", F.struct("id", "chrom", "st", "en").alias("key"))
    return evaluation.covered_targets(named, rows.where("line = 2"), 60, ["key"], exclude=rows.where("line = 3")).select("key.*")


@query("SELECT p_partkey AS aln_id, upper(repeat('ac', p_size::INTEGER) || 'g' || 'tt') AS target, upper(repeat('ac', p_size::INTEGER) || 't' || 'gg') AS query FROM part")
def cs_sequences(spark, sf_dir):
    cs = F.concat(F.lit("="), F.expr("repeat('AC', p_size)"), F.lit("*gt-tt+gg"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("aln_id"), cs.alias("cs"))
    return rows.select("aln_id", F.upper(variants.cs_sequence("cs", False)).alias("target"), F.upper(variants.cs_sequence("cs", True)).alias("query"))
