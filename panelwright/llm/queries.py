"""The registered queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text without its white-space class, for DuckDB: lists of words.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS p FROM h JOIN f USING (k) WHERE f.first < h.doc_id),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN r.n IS NULL THEN d.w ELSE list_filter(d.w, lambda x, j: NOT list_contains(r.ps, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


@_query("op2_substring_dedup", _OP2_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.substring import substring_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT e.a, e.b FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b WHERE 100 * e.c >= 85 * (x.n + y.n - e.c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""


@_query("op10_near_duplicates", _OP10_SQL)
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, k.item_id FROM p JOIN k ON p.s = k.s AND p.n = k.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@_query("op3_decontaminate", _OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.decontam import decontaminate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"), n=13, min_percent=5)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


_OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, host, line, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l WHERE len(lw) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM f GROUP BY doc_id),
o AS (SELECT host, k, count(DISTINCT doc_id) AS c FROM f GROUP BY host, k),
z AS (SELECT host, count(DISTINCT doc_id) AS c FROM d GROUP BY host),
b AS (SELECT o.host, o.k FROM o JOIN z USING (host) WHERE o.c > 10 AND (o.c * 100 > z.c * 1.0 OR o.c > 1000)),
m AS (SELECT doc_id, sum(n) AS n FROM f JOIN b USING (host, k) GROUP BY doc_id),
a AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_line_words <= 80 * n_words AS kept FROM a
"""


@_query("op5_line_quality", _OP5_SQL)
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.linequality import line_quality

    return line_quality(_table(spark, sf_dir, "documents"), host="source", min_docs=10, host_percent=1.0, most_docs=1000, depleted_percent=80)


#: The entries of the url query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@_query("op7_url_filter", _OP7_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.urltrie import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@_query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.toxicity import score_toxicity, train_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


@_query("op6_pack")
def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelwright.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


@_query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelwright.llm.rans import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.qualitylr import classify_quality, train_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train_quality(docs, _table(spark, sf_dir, "labels"))
    return classify_quality(docs, weights, threshold=0.7).select("doc_id", "held_out", "score", "predicted")


@_query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.htmlcrf import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=16)


_OP13_SQL = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM turns),
l AS (SELECT c, list({'k': k, 'n': n} ORDER BY p) AS own FROM o GROUP BY c),
h AS (SELECT l.c, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(l.c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 4 AS h FROM l, tbl),
s AS (SELECT h.c, list_concat(CASE WHEN b.own IS NULL THEN h.own[1:0] ELSE b.own[1:h.h] END, h.own[h.h + 1:]) AS q FROM h LEFT JOIN l b ON b.c = h.c - h.c % 20),
z AS (SELECT c, d, len(q) = d AS last, array_to_string(list_transform(q[1:d], lambda x: x.k), '') AS id,
  CASE WHEN d > 0 THEN array_to_string(list_transform(q[1:d - 1], lambda x: x.k), '') END AS up, CASE WHEN d > 0 THEN q[d].n ELSE 0 END AS n FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM s)),
g AS (SELECT id, up, d, min(c) AS conv_id, count(*) AS n_convs, min(n) AS n,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM z GROUP BY id, up, d),
k AS (SELECT up AS id, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT a.id, count(*) FILTER (k.id IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.n) AS saved_tokens
  FROM (SELECT DISTINCT a.id, b.id AS below FROM z a JOIN z b ON a.c = b.c AND a.d <= b.d) a JOIN g ON g.id = a.below LEFT JOIN k ON k.id = a.below GROUP BY a.id)
SELECT g.conv_id, g.d::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
  w.n_leaves::BIGINT AS n_leaves, w.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN g u ON u.id = g.up LEFT JOIN k ON k.id = g.id JOIN w ON w.id = g.id
"""


@_query("op13_prefix_trie", _OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.prefixtrie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


@_query("op12_near_vectors")
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.vectordedup import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"), limit=0.9)[0]
