"""Registered queries of the corpus operators and, where SQL can say it, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import (
    cells,
    chat,
    covertree,
    divergence,
    langid,
    lines,
    mixing,
    ordermin,
    pieces,
    tokencount,
    toxicity,
    trie,
    urls,
    vectors,
)
from parcelflow.llm.tables import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Rows of this remainder are kept out of what a model learns from.
FOLDS = 5

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A conversation whose texts imitate the marks of the template.
TRICKY_ID = -7
TRICKY_TEXT = "\\### Assistant: </turn> ok"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


@query("op4_source_mixing")
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document when all sources are mixed to weights 5, 2, 1."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(
    "op6_url_filters",
    """
    WITH rules(action, host, path) AS (VALUES
        ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0
        THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
    parsed AS (SELECT page_id,
        coalesce(lower(regexp_extract(r, '^[^/?#]*')), '') AS host,
        coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
    fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.action,
        row_number() OVER (PARTITION BY p.page_id
            ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
        FROM parsed p LEFT JOIN rules r
        ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
    """,
)
def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark, URL_RULES)).drop("url")


@query(
    "op7_chat_formatting",
    """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>') AS x,
        replace(replace(replace(replace(role, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>'), ':', '\\:') AS y
        FROM t),
    s AS (SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w, 'start') || '>' || role AS step
        FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(x) + length(y) + 13) + count(*) - 1 AS BIGINT) AS formatted_chars,
        CAST(coalesce(min(n) FILTER (step NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant',
            'assistant>user')), CASE WHEN arg_max(role, n) <> 'assistant' THEN 0 END) AS INTEGER) AS fault
    FROM s GROUP BY conv_id
    """,
)
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of what is read back from every formatted conversation, and its first wrong turn."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(TRICKY_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(TRICKY_TEXT).alias("text"),
    )
    made = chat.format_conversations(given.unionByName(tricky))
    read = made.select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("segments")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "fault",
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "fault",
    )


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    known = docs.filter(~held_out(F.col("doc_id")))
    model = langid.fit(known)
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), model.predict(F.col("text")).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


@query(
    "op2_exact_topk",
    """
    WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
        FROM embeddings WHERE embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id,
        CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
        FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
        AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    vectors_ = table(spark, folder, "embeddings").select("vec_id", "embedding")
    points = vectors.floored(vectors_, "vec_id", "embedding", scale=64)
    return covertree.top_k(points.filter("id % 20 = 0"), points, k=20).select(
        F.col("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )


@query(
    "op9_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
        e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
)
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, group and survivor of every vector, compared within its label."""
    return cells.near_duplicates(table(spark, folder, "embeddings"), threshold=0.98)


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class and survivor of every line of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.line_classes(docs).drop("doc")


@query("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates and survivor of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ordermin.near_duplicates(docs).drop("key")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labels of four fifths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = table(spark, folder, "labels").filter(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs, known)
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """A sampled segmentation of every document and whether decoding gives the text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs).drop("text")


@query(
    "op11_source_divergence",
    """
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
    v AS (SELECT lang, term, count(*) AS y FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(y) AS n FROM v GROUP BY ALL),
    q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (y + 2) // (n + 2 * v.count) AS q
        FROM (SELECT v.lang, term, y, n, l.v AS count FROM v JOIN l USING (lang)) v),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS x FROM t GROUP BY ALL),
    x AS (SELECT g.lang, g.source, v.term, coalesce(c.x, 0) AS x FROM g JOIN v USING (lang)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
    n AS (SELECT lang, source, sum(x) AS n FROM x GROUP BY ALL),
    p AS (SELECT x.lang, x.source, term, x, 1 + 1000000000::HUGEINT * (x + 2) // (n.n + 2 * l.v) AS p
        FROM x JOIN n USING (lang, source) JOIN l USING (lang)),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT)
        AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    best AS (SELECT p.lang, source, 'term' AS part, term AS item,
        CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
        FROM p JOIN q USING (lang, term) WHERE x > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)
        AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
    SELECT * FROM r WHERE part = 'pair' OR rank <= 10
    """,
)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Every source beside the others of its language, and the terms it uses more than the language."""
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every whole document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs).drop("text")


# Conversations share up to HEADS turns with the one whose id is the multiple of FORK below theirs.
FORK, HEADS = 20, 3


def rebuilt(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Turns of all conversations, the first h of each taken from the conversation it forks off, where h is
    the CRC of its id modulo ``HEADS + 1``."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)
    own = turns.filter(F.col("pos") > shared).withColumn("pos", F.col("pos") + HEADS)
    first = turns.filter((F.col("pos") <= HEADS) & (F.col("conv_id") % FORK == 0))
    forks = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FORK).alias("base"))
    heads = forks.join(first.withColumnRenamed("conv_id", "base"), "base").filter(F.col("pos") <= shared)
    return own.unionByName(heads.select(own.columns))


@query(
    "op13_conversation_prefix_trie",
    """
    WITH RECURSIVE steps(i, k, v) AS (SELECT range, 0, range FROM range(256)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
        FROM steps WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS crcs FROM steps WHERE k = 8),
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
        FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
        string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8))) % 4 AS h FROM c, crc),
    r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []),
        list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
        FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, len(turns) AS length, d, list_slice(turns, 1, d) AS path
        FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
    n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) > d AS inner_node,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), ''))
            AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1)
            * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
        FROM p GROUP BY path, d),
    s AS (SELECT list_slice(path, 1, u) AS path, CAST(sum(saved) AS BIGINT) AS saved_tokens,
        count(*) FILTER (NOT inner_node) AS n_leaves, count(*) FILTER (d = u + 1) AS n_children
        FROM (SELECT *, unnest(range(d + 1)) AS u FROM n) GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
        s.saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.path = n.path LEFT JOIN n m ON n.d > 0 AND m.path = list_slice(n.path, 1, n.d - 1)
    """,
)
def op13_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the tree of conversations that share beginnings."""
    turns = settle(trie.ordered_turns(table(spark, folder, "conversations")))
    conversations = turns.filter("pos = 1").select("conv_id")
    return trie.prefix_trie(rebuilt(turns, conversations), conversations)
