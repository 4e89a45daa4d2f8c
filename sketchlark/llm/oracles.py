"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from sketchlark.llm import jaccard, packing, quality, sharding, vectors

_SPACE = r"[^\x20\x09-\x0D]+"
#: Words of every text, and its bytes as numbers, in order.
_WORDS = f"wd AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents)"
_BYTES = "bt AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents)"


def _crc_table() -> str:
    """The checksum's table: each byte shifted out bit by bit, the polynomial added where a bit falls off."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"[{', '.join(map(str, out))}]"


def _components(links: str, of: str) -> str:
    """reach and comp (id, component): the smallest id that each id of table ``of`` reaches by the pairs (a, b) of ``links``."""
    return f"""reach(id, other) AS (SELECT id, id FROM {of} UNION SELECT reach.id, {links}.b FROM reach JOIN {links} ON reach.other = {links}.a), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


OP1 = f"""WITH {_BYTES}, r AS (SELECT d.doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM documents d JOIN bt ON d.doc_id = bt.doc_id), s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS first, sum(size) OVER () AS total FROM r),
c AS (SELECT *, least({sharding.N_SHARDS - 1}, ((2 * first + size) * {sharding.N_SHARDS}) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM c"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP2 = f"""WITH RECURSIVE {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")},
sh AS (SELECT DISTINCT doc_id AS id, CASE WHEN len(w) < {jaccard.WORDS} THEN w ELSE w[i : i + {jaccard.WORDS - 1}] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {jaccard.WORDS - 1}) + 1)) AS i FROM wd WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id), both_have AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE 100 * shared >= {jaccard.PERCENT} * (p.n + q.n - shared)),
docs AS (SELECT doc_id AS id FROM documents), {_components('link', 'docs')}
SELECT d.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component AS component_id FROM docs d LEFT JOIN n ON d.id = n.id JOIN comp ON d.id = comp.id"""

OP3 = f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), fine AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= {vectors.THRESHOLD!r}::DOUBLE),
ids AS (SELECT vec_id AS id FROM embeddings), {_components('link', 'ids')}, many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT ids.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, ids.id = component AS kept FROM ids JOIN comp ON ids.id = comp.id LEFT JOIN many ON ids.id = a"""

_SCALE = f"{quality.SCALE}::DOUBLE"
OP4 = f"""WITH {_WORDS}, {_BYTES}, tr AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
bs AS (SELECT doc_id, unnest(list_append(b, 32)) AS x, unnest(range(len(b) + 1)) AS i FROM bt), b3 AS (SELECT doc_id, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM bs WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
gr AS (SELECT doc_id, ((x * 66049 + y * 257 + z) * 2654435761 % 4294967296) // {(1 << 32) // quality.N_BUCKETS} AS x FROM b3 WHERE z IS NOT NULL),
ct AS (SELECT x, count(*)::DOUBLE AS r, (count(*) FILTER (tr.doc_id IS NOT NULL))::DOUBLE AS t FROM gr LEFT JOIN tr ON gr.doc_id = tr.doc_id GROUP BY x), tot AS (SELECT sum(t) AS t, sum(r) AS r FROM ct),
ra AS (SELECT x, CASE WHEN tot.t = 0 THEN 0 ELSE round_even((ln(ct.t + 1) - ln(ct.r * (tot.t / tot.r) + 1)) * {_SCALE}, 0) END AS q FROM ct, tot), ll AS (SELECT doc_id, (sum(q::BIGINT)::DOUBLE) / count(*) / {_SCALE} AS llr FROM gr JOIN ra USING (x) GROUP BY doc_id),
wr AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM wd), wi AS (SELECT doc_id, i, lead(x, {quality.WINDOW - 1}) OVER o IS NOT NULL AS whole, {' || chr(1) || '.join(f'lead(x, {k}) OVER o' for k in range(quality.WINDOW))} AS g FROM wr WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
tw AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wi WHERE whole),
rp AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tw, (SELECT unnest(range({quality.WINDOW})) AS k) WHERE n > 1 GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents), dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM li WHERE regexp_matches(l, '{_SPACE}') GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0) AS llr
  FROM documents d JOIN wd USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN ll USING (doc_id)), f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND llr >= {quality.THRESHOLD!r}::DOUBLE AS kept, round(llr, 6) AS llr FROM f"""

def _packing() -> str:
    """The dynamic program, one step a bucket: cost of the first j lengths in k buckets and where the last one begins; then back from the end."""
    steps = ["d0 AS (SELECT 0::BIGINT AS j, 0::DOUBLE AS c, 0::BIGINT AS f)"]
    back = [f"b{packing.N_BUCKETS} AS (SELECT j, f FROM d{packing.N_BUCKETS} WHERE j = (SELECT j FROM size))"]
    for k in range(1, packing.N_BUCKETS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT j, m.c AS c, m.f AS f FROM (SELECT h.j, min(struct_pack(c := d{k - 1}.c + (h.many - o.many) * h.n, f := o.j)) AS m FROM hs h JOIN d{k - 1} ON d{k - 1}.j < h.j JOIN pt o ON o.j = d{k - 1}.j GROUP BY h.j))")
    back += [f"b{k} AS (SELECT d{k}.j, d{k}.f FROM d{k} JOIN b{k + 1} ON d{k}.j = b{k + 1}.f)" for k in range(packing.N_BUCKETS - 1, 0, -1)]
    ends = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, j FROM b{k}" for k in range(1, packing.N_BUCKETS + 1))
    return f"""WITH {_WORDS}, pc AS (SELECT doc_id, p AS piece, least({packing.MAX_LEN}, n - p * {packing.MAX_LEN}) AS n FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(range((len(w) - 1) // {packing.MAX_LEN} + 1)) AS p FROM wd WHERE len(w) > 0)),
hs AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n) AS j, (sum(count(*)) OVER (ORDER BY n))::DOUBLE AS many FROM pc GROUP BY n), size AS (SELECT max(j) AS j FROM hs), pt AS (SELECT 0::BIGINT AS j, 0::DOUBLE AS many UNION ALL SELECT j, many FROM hs),
{', '.join(steps)}, {', '.join(back)}, ends AS (SELECT bucket, n AS bucket_len, coalesce(lag(n) OVER (ORDER BY n), 0) AS above FROM ({ends}) e JOIN hs USING (j)),
pl AS (SELECT pc.*, bucket, bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece) - 1 AS r, greatest(1, {packing.TOKEN_BUDGET} // bucket_len) AS room FROM pc JOIN ends ON pc.n > above AND pc.n <= bucket_len)
SELECT doc_id, piece, piece * {packing.MAX_LEN} AS first_token, n AS n_tokens, bucket::INTEGER AS bucket, bucket_len, bucket_len - n AS padding, (r // room)::BIGINT AS batch, (r % room)::BIGINT AS slot FROM pl"""


OP10 = _packing()

ORACLES = {"op1_sharding": OP1, "op2_jaccard": OP2, "op3_vectors": OP3, "op4_quality": OP4, "op10_packing": OP10}
