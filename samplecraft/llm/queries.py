"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..util import unused_name
from . import cdc, decontaminate, html_crf, jaccard, linespread, packing, quality, repair, secrets, simhash, trie, urlcascade, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("text_hash")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_spans(table(spark, sf_dir, "documents")).drop("t")


def op5_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_crf.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.chunk_table(warc.plan_records(table(spark, sf_dir, "pages"))), path)
    return warc.read_payloads(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
                                                  "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op9_distinct_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = unused_name(docs, "removed")
    marked = linespread.mark(docs, name=removed)
    return marked.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.array_size(removed), F.lit(0)).cast("long").alias("n_removed"),
        F.md5(linespread.cleaned("text", removed).cast("binary")).alias("clean_md5"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS a
           FROM documents),
     l AS (SELECT rid, source, i, a[i] AS line, {'t': md5(text), 'i': i} AS place, CASE WHEN i > 1 THEN a[i - 1] ELSE '' END AS prev,
                  CASE WHEN i < len(a) THEN a[i + 1] ELSE '' END AS next
           FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM d WHERE text IS NOT NULL)),
     b AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
           HAVING count(DISTINCT source) >= 10 AND count(DISTINCT {'p': prev, 'n': next}) >= 10
                  AND 2 * count(DISTINCT {'p': prev, 'n': next}) >= count(DISTINCT place)),
     r AS (SELECT rid, count(*) FILTER (b.line IS NOT NULL) AS n_removed,
                  coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS clean
           FROM l LEFT JOIN b ON b.line = l.line GROUP BY rid)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(clean) AS clean_md5
FROM d LEFT JOIN r USING (rid)
"""


#: A page whose title has a run of symbols puts its key on the list.
SPAM_TITLE = r"<title>[^<]*(%%%|###|[*][*][*]|[$][$][$])"


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urlcascade.judge(pages, F.col("html").rlike(SPAM_TITLE))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH r AS (SELECT page_id, html,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
     p AS (SELECT page_id, coalesce(regexp_matches(html, '{SPAM_TITLE}'), false) AS spam,
                  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
           FROM r),
     l AS (SELECT host || path AS k, bool_or(spam) AS listed FROM p GROUP BY 1),
     v AS (SELECT p.*, listed,
                  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/')
                            THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/')
                            THEN 'example.com/de/'
                       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
           FROM p JOIN l ON l.k = host || path)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
                 WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
                 ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM v
"""



def op11_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: CRC-32 of an ASCII string; the table follows from the polynomial.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of"""


def _crc(s: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({s}) + 1),
                lambda i: CAST(ord({s}[i]) AS BIGINT))), lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])))"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH k AS ({CRC_TABLE}),
     d AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h
           FROM (SELECT DISTINCT conv_id FROM d), k),
     s AS (SELECT c.*, least(h, coalesce(n, 0)) AS shown
           FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM d GROUP BY 1) USING (base)),
     r AS (SELECT s.conv_id, pos AS depth, role, text FROM s JOIN d ON d.conv_id = s.base AND d.pos <= s.h
           UNION ALL
           SELECT s.conv_id, shown + pos - h, role, text FROM s JOIN d ON d.conv_id = s.conv_id AND d.pos > s.h),
     m AS (SELECT conv_id, depth, length(text) AS chars,
                  sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS p
           FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM s),
     e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY 1),
     n AS (SELECT p, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                  sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)
                                  FILTER (e.depth = m.depth), '')) AS ends_sha256
           FROM m JOIN e USING (conv_id) GROUP BY p, m.depth),
     f AS (SELECT n.*, q.conv_id AS parent_conv_id, q.p AS parent
           FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n q ON q.p = m.p),
     g AS (SELECT parent, count(*) AS n_children FROM f WHERE parent IS NOT NULL GROUP BY 1),
     b AS (SELECT m.p, count(*) FILTER (g.parent IS NULL) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
           FROM f LEFT JOIN g ON g.parent = f.p JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.p)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN b ON b.p = f.p LEFT JOIN g ON g.parent = f.p
"""


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


#: Edits as moves (state, segment, role initial or null for any, next state, cost); states: 0 start, 1 s, 2 u, 3 a.
OP13_SQL = rf"""
WITH RECURSIVE k AS ({CRC_TABLE}),
     o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {_crc('key')} % 20 AS kind
           FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
                 FROM conversations), k),
     d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM o JOIN range(2) AS c(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
     p AS (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again
           FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
     f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM p),
     put(q, to_q) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
     own(q, seg, x, to_q, cost) AS (
         SELECT q, 'D', CAST(NULL AS VARCHAR), q, 3 FROM put UNION ALL SELECT q, 'R', NULL, to_q, 2 FROM put
         UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
     moves AS (SELECT q, seg, x, to_q, cost, seg AS op, CAST(NULL AS INT) AS ins FROM own
               UNION ALL SELECT put.q, 'I' || seg, x, own.to_q, own.cost + 2, seg, put.to_q FROM put JOIN own ON own.q = put.to_q),
     ends(q, seg, cost, tail) AS (VALUES (0, '', 0, CAST([] AS VARCHAR[])), (1, 'II', 4, ['user:', 'assistant:']),
                                         (2, 'I', 2, ['assistant:']), (3, '', 0, CAST([] AS VARCHAR[]))),
     st AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS rows
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT st.conv_id, f.i, to_q, st.cost + m.cost + CAST(fault = 'truncated' AND op <> 'D' AS INT), audit || seg,
                   rows || CASE ins WHEN 2 THEN ['user:'] WHEN 3 THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END
                        || CASE WHEN op = 'D' THEN CAST([] AS VARCHAR[]) WHEN op = 'K' THEN [role || ':' || text]
                                WHEN to_q = 2 THEN ['user:' || text] ELSE ['assistant:' || text] END
            FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1
                 JOIN moves m ON m.q = st.q AND (m.x IS NULL OR m.x = f.x) AND (fault NOT IN ('blank', 'duplicate') OR op = 'D')
            QUALIFY row_number() OVER (PARTITION BY st.conv_id, to_q
                                       ORDER BY st.cost + m.cost + CAST(fault = 'truncated' AND op <> 'D' AS INT), audit || seg) = 1),
     g AS (SELECT conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (i > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal
           FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id)
SELECT g.conv_id, gaps, blank, duplicate, truncated, illegal, st.cost + e.cost AS cost, audit || seg AS audit,
       sha256(array_to_string(rows || tail, chr(10))) AS repaired_sha256
FROM st JOIN g ON g.conv_id IS NOT DISTINCT FROM st.conv_id AND g.n = st.i JOIN ends e ON e.q = st.q
QUALIFY row_number() OVER (PARTITION BY g.conv_id ORDER BY st.cost + e.cost, audit || seg) = 1
"""

QUERIES = {"op1_best_fit_packing": op1_best_fit_packing,
           "op2_repetition_coverage": op2_repetition_coverage,
           "op3_decontamination": op3_decontamination,
           "op4_chunk_dedup": op4_chunk_dedup,
           "op5_html_crf": op5_html_crf,
           "op6_warc_chunks": op6_warc_chunks,
           "op7_secret_forest": op7_secret_forest,
           "op8_parity_sketch_join": op8_parity_sketch_join,
           "op9_distinct_site_spread": op9_distinct_site_spread,
           "op10_bloom_cascade": op10_bloom_cascade,
           "op11_simhash_tiles": op11_simhash_tiles,
           "op12_prefix_trie": op12_prefix_trie,
           "op13_turn_repair": op13_turn_repair}
ORACLES: dict[str, str] = {"op9_distinct_site_spread": OP9_SQL, "op6_warc_chunks": OP6_SQL, "op10_bloom_cascade": OP10_SQL,
                           "op12_prefix_trie": OP12_SQL, "op13_turn_repair": OP13_SQL}
