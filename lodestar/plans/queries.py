"""Queries over the test tables, each with SQL for another engine where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import focus_text, nul_joined, ordered_digest, seeded_ratio, sha_hex, stable_rank
from ..functions.vectors import hash_embedding
from ..operators import audit, context, dense, fusion, labels, lexical, messages, metrics, pooling, review, similarity, state, tombstones, units
from ..sources import archive
from . import pipelines, publish
from . import tables as t
from .publish import written

SEED = 20260912
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL (after the shared tables) if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:  # it goes on after the shared tables: with a comma for more of them
            SQL[f.__name__] = f"WITH RECURSIVE {t.MESSAGES_SQL.strip()}\n{sql}"
        return f

    return put


def joined(c):
    """An array as text, so that results compare between engines."""
    return F.array_join(c, ",")


# Messages ---------------------------------------------------------------------------------------------------------------------


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of the conversations; some have a field that isn't right, by turn."""
    m = t.conversation_messages(spark, sf_dir).withColumn("turn", F.col("created_utc") % 1000)
    value = F.expr("substring(to_json(struct(raw_body)), 13, length(to_json(struct(raw_body))) - 13)")
    time = F.when(F.col("turn") == 3, F.lit("true")).when(F.col("turn") == 4, F.concat(F.col("created_utc").cast("string"), F.lit(".5"))).when(F.col("turn") == 2, F.concat(F.col("created_utc").cast("string"), F.lit(".0"))).otherwise(F.col("created_utc").cast("string"))
    submission = F.col("kind") == "submission"
    raw = F.concat(
        F.lit('{"name":"'), "fullname", F.lit('","subreddit":"'), "subreddit", F.lit('","created_utc":'), time, F.when(F.col("turn") == 5, F.lit("")).otherwise(F.concat(F.lit(',"permalink":"'), "permalink", F.lit('"'))),
        F.when(submission, F.concat(F.lit(',"title":"","selftext":'), value)).otherwise(F.concat(F.lit(',"link_id":"'), "thread_fullname", F.lit('","parent_id":"'), "parent_fullname", F.lit('","body":'), value)), F.lit("}"),
    )
    return m.select(F.lit("s").alias("source_id"), F.col("kind").alias("source_kind"), F.col("created_utc").alias("line_number"), raw.alias("raw_line"))


@query("""SELECT fullname, kind, thread_fullname, parent_fullname, subreddit, CASE WHEN turn IN (3, 4) THEN NULL ELSE created_utc END AS created_utc, source_revision_id, CASE WHEN turn = 5 THEN NULL ELSE permalink END AS permalink,
  CASE WHEN turn = 5 THEN 'permalink: no text' WHEN turn IN (3, 4) THEN 'created_utc: no whole number of seconds' END AS norm_error FROM cm""")
def normalize_messages(spark, sf_dir):
    n = messages.normalize(_envelopes(spark, sf_dir))
    return n.select("fullname", "kind", "thread_fullname", "parent_fullname", "subreddit", "created_utc", "source_revision_id", "permalink", "norm_error")


@query("""SELECT count(*) FILTER (turn NOT IN (3, 4, 5))::BIGINT AS valid, count(*) FILTER (turn IN (3, 4, 5))::BIGINT AS rejected FROM cm""")
def normalize_split(spark, sf_dir):
    n = written(messages.normalize(_envelopes(spark, sf_dir)))
    return messages.valid(n).agg(F.count("*").alias("valid")).join(messages.rejected(n).agg(F.count("*").alias("rejected")))


@query("""SELECT fullname, sha256('20260912' || chr(0) || fullname) AS digest FROM dm ORDER BY digest, fullname LIMIT 100""")
def stable_hash_sample(spark, sf_dir):
    return messages.top_by_hash(t.document_messages(spark, sf_dir), 100, SEED).select("fullname", stable_rank(SEED, F.col("fullname")).alias("digest"))


@query("""SELECT fullname, created_utc FROM (SELECT subreddit AS fullname, max(created_utc) AS created_utc FROM dm GROUP BY subreddit) ORDER BY sha256('20260912' || chr(0) || fullname), fullname LIMIT 10""")
def control_sample(spark, sf_dir):
    rows = t.document_messages(spark, sf_dir).select(F.col("subreddit").alias("fullname"), "created_utc")
    return messages.control_sample(rows, 10, SEED, [F.col("created_utc")]).select("fullname", "created_utc")


@query("""SELECT subreddit AS fullname, min(created_utc) AS created_utc FROM dm GROUP BY subreddit""")
def first_of_name(spark, sf_dir):
    rows = t.document_messages(spark, sf_dir).select(F.col("subreddit").alias("fullname"), "created_utc")
    return messages.one_per_name(rows, [F.col("created_utc")])


@query("""SELECT fullname FROM dm WHERE (('0x' || substr(sha256('20260912' || chr(0) || fullname || chr(0) || ''), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE < 0.1""")
def seeded_bernoulli(spark, sf_dir):
    m = t.document_messages(spark, sf_dir)
    return m.where(seeded_ratio(SEED, F.col("fullname"), F.lit("")) < 0.1).select("fullname")


RULES = {"licence": [["license", "licence", "rights"], ["version", "reserved"]], "insult": [["idiot", "moron", "stupid"]], "rare": [["creative"], ["commons"]], "street": [["straße"], ["hausnummer", "ﬁnden"]]}


_RULE_SQL = """ (contains(lower(raw_body), 'license') OR contains(lower(raw_body), 'licence') OR contains(lower(raw_body), 'rights')) AND (contains(lower(raw_body), 'version') OR contains(lower(raw_body), 'reserved'))"""
_INSULT_SQL = "(contains(lower(raw_body), 'idiot') OR contains(lower(raw_body), 'moron') OR contains(lower(raw_body), 'stupid'))"


def _rule_sql(groups: list[list[str]]) -> str:
    """A rule over the folded text; the terms are folded here."""
    return " AND ".join("(" + " OR ".join(f"contains(folded, '{term.casefold()}')" for term in group) + ")" for group in groups)


# Some texts get words whose folding isn't their lower case.
_FOLDED_SQL = """, fo AS (SELECT fullname, replace(replace(lower(raw_body || CASE WHEN doc_id % 6 = 0 THEN ' Die Straße, HAUSNUMMER 1' WHEN doc_id % 7 = 0 THEN ' die STRASSE zu ﬁnden' WHEN doc_id % 8 = 0 THEN ' Strasse' ELSE '' END), 'ß', 'ss'), 'ﬁ', 'fi') AS folded FROM dm)
"""


@query(_FOLDED_SQL + "SELECT fullname, rules, 'topic_rule' AS channels FROM (SELECT fullname, concat_ws(',', " + ", ".join(f"CASE WHEN {_rule_sql(groups)} THEN '{rule}' END" for rule, groups in RULES.items()) + """) AS rules FROM fo) WHERE rules <> ''
ORDER BY sha256('20260912' || chr(0) || fullname), fullname LIMIT 200""")
def discovery_select(spark, sf_dir):
    """Tombstones first, then rules, then the least digests; here without tombstones."""
    n = F.col("created_utc")
    more = F.when(n % 6 == 0, " Die Straße, HAUSNUMMER 1").when(n % 7 == 0, " die STRASSE zu ﬁnden").when(n % 8 == 0, " Strasse").otherwise("")
    found = messages.discover(t.document_messages(spark, sf_dir).withColumn("raw_body", F.concat("raw_body", more)), RULES)
    return messages.top_by_hash(found, 200, SEED).select("fullname", joined("matched_rule_ids").alias("rules"), joined("selection_channels").alias("channels"))


@query("""SELECT count(*)::BIGINT AS selected, count(DISTINCT thread_fullname)::BIGINT AS threads FROM cm WHERE turn > 0""")
def thread_freeze(spark, sf_dir):
    return messages.thread_freeze(t.conversation_messages(spark, sf_dir).where("kind = 'comment'"))


@query("""SELECT fullname, CASE WHEN raw_body = '' THEN '' ELSE raw_body END AS focus FROM cm""")
def message_focus_text(spark, sf_dir):
    return t.conversation_messages(spark, sf_dir).select("fullname", focus_text(F.col("raw_title"), F.col("raw_body")).alias("focus"))


# Context ----------------------------------------------------------------------------------------------------------------------

_KEPT = "created_utc % 1000 <> 2"  # some parents are missing



# The walk in SQL: from turn k the parents are k - 1, k - 2, ...; turn 2 is absent, so walks end there.
_CHAIN_SQL = """, have AS (SELECT * FROM cm WHERE turn <> 2),
steps AS (SELECT h.fullname, h.conv_id, h.turn, h.kind, h.thread_fullname, CASE WHEN h.turn = 0 THEN 0 WHEN h.turn <= 2 THEN h.turn ELSE least(h.turn - 3, 4) END AS n,
  h.turn > 2 AND h.turn - 3 < 4 AS hits_gap, CASE WHEN h.turn > 2 THEN h.turn - 4 > 2 OR h.turn - 4 = 2 ELSE false END AS long FROM have h),
a AS (SELECT *, hits_gap AS gap, NOT hits_gap AND turn > 2 AS cut FROM steps),
told AS (SELECT a.*, (SELECT list(CASE WHEN k = 0 THEN 't3_c' || a.conv_id ELSE 't1_c' || a.conv_id || '_' || k END ORDER BY k) FROM range(0, 100) r(k) WHERE k < a.turn AND k >= a.turn - a.n) AS chain FROM a)
"""


@query(_CHAIN_SQL + """SELECT fullname, CASE WHEN turn > 0 AND NOT list_contains(coalesce(chain, []), thread_fullname) THEN concat_ws(',', thread_fullname, nullif(array_to_string(chain, ','), '')) ELSE coalesce(array_to_string(chain, ','), '') END AS ancestors,
  CASE WHEN gap THEN 't1_c' || conv_id || '_2' ELSE '' END AS missing, NOT gap AND NOT cut AS context_complete, false AS parent_cycle_detected, cut AS ancestors_truncated FROM told""")
def ancestor_chain(spark, sf_dir):
    have = t.conversation_messages(spark, sf_dir).where(_KEPT)
    c = context.ancestor_chains(have)
    return c.select("fullname", joined("ancestors").alias("ancestors"), joined("missing_parent_ids").alias("missing"), "context_complete", "parent_cycle_detected", "ancestors_truncated")


def _hydration(spark, sf_dir):
    m = t.conversation_messages(spark, sf_dir)
    selected = m.where("created_utc % 1000 = 1 AND created_utc % 3 = 0")
    gone = m.where("created_utc % 11 = 0").select(F.col("fullname").alias("message_fullname"), F.when(F.col("created_utc") % 2 == 0, F.col("source_revision_id")).alias("source_revision_id"))
    return m, selected, gone


_CLASS_SQL = """, sel AS (SELECT * FROM cm WHERE turn = 1 AND created_utc % 3 = 0),
cls AS (SELECT cm.*, CASE WHEN created_utc % 11 = 0 THEN 'tombstoned' WHEN fullname IN (SELECT fullname FROM sel) THEN 'selected' WHEN thread_fullname IN (SELECT thread_fullname FROM sel) THEN 'context' ELSE 'control' END AS class FROM cm)
"""


@query(_CLASS_SQL + "SELECT class, count(*)::BIGINT AS n FROM cls GROUP BY class")
def hydration_classes(spark, sf_dir):
    return context.hydration_classes(*_hydration(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


@query(_CLASS_SQL + """SELECT * FROM (SELECT fullname, class, created_utc AS first_seen FROM cls WHERE class = 'context' ORDER BY sha256('20260912' || chr(0) || fullname), fullname LIMIT 50)
UNION ALL SELECT * FROM (SELECT fullname, class, created_utc FROM cls WHERE class = 'control' ORDER BY sha256('20260913' || chr(0) || fullname), fullname LIMIT 20)""")
def hydrate_partition(spark, sf_dir):
    """Every second message is in the archive once more, later; the first of a name counts."""
    m, selected, gone = _hydration(spark, sf_dir)
    n = F.col("created_utc")
    again = m.where(n % 2 == 0).withColumn("created_utc", n + 10**9)
    return context.hydrate(again.unionByName(m), selected, gone, 50, 20, SEED, [n]).select("fullname", "class", n.alias("first_seen"))


@query("""SELECT fullname, CASE WHEN turn % 2 = 0 THEN 'context' ELSE subreddit END AS subreddit FROM cm""")
def merged_messages(spark, sf_dir):
    m = t.conversation_messages(spark, sf_dir)
    other = m.where("created_utc % 1000 % 2 = 0").withColumn("subreddit", F.lit("context"))
    return context.merged_messages(m, other).select("fullname", "subreddit")


@query("""SELECT fullname FROM cm QUALIFY row_number() OVER (PARTITION BY thread_fullname ORDER BY created_utc DESC) <= 3""")
def thread_cap(spark, sf_dir):
    return messages.thread_cap(t.conversation_messages(spark, sf_dir).withColumn("rank", -F.col("created_utc")), 3).select("fullname")


# Units ------------------------------------------------------------------------------------------------------------------------


def _spans_sql(rows: str, max_words: int, overlap: int) -> str:
    """Tables of the chunks of rows (fullname, raw_body): paragraphs, packed by a walk from one to the next, and windows of long ones."""
    step, space = max_words - overlap, units.WORD.replace("[^", "[", 1).removesuffix("+")
    return f"""ln AS (SELECT fullname, line, k, k = n AS last FROM (SELECT fullname, unnest(str_split(raw_body, chr(10))) AS line, generate_subscripts(str_split(raw_body, chr(10)), 1) AS k, len(str_split(raw_body, chr(10))) AS n FROM {rows})),
pa AS MATERIALIZED (SELECT fullname, line, a, a + len(line) + CASE WHEN last THEN 0 ELSE 1 END AS b, len(regexp_extract_all(line, '{units.WORD}')) AS n, row_number() OVER (PARTITION BY fullname ORDER BY a) AS i
  FROM (SELECT *, sum(len(line) + 1) OVER (PARTITION BY fullname ORDER BY k) - len(line) - 1 AS a FROM ln) WHERE line <> ''),
pl AS MATERIALIZED (SELECT fullname, list({{'n': n, 'a': a, 'b': b}} ORDER BY a) AS ps FROM pa GROUP BY fullname),
pk AS (SELECT fullname, 1 AS i, ps, NULL::HUGEINT AS put_a, NULL::HUGEINT AS put_b, CASE WHEN ps[1].n <= {max_words} THEN ps[1].a END AS s, ps[1].b AS e, CASE WHEN ps[1].n <= {max_words} THEN ps[1].n ELSE 0 END AS c FROM pl
  UNION ALL SELECT fullname, i + 1, ps, CASE WHEN p.n > {max_words} OR c > 0 AND c + p.n > {max_words} THEN s END, e, CASE WHEN p.n > {max_words} THEN NULL WHEN c > 0 AND c + p.n <= {max_words} THEN s ELSE p.a END, p.b,
    CASE WHEN p.n > {max_words} THEN 0 WHEN c > 0 AND c + p.n <= {max_words} THEN c + p.n ELSE p.n END FROM (SELECT *, ps[i + 1] AS p FROM pk WHERE i < len(ps))),
wd AS (SELECT fullname, i, n, a, j, sum(len(m)) OVER (PARTITION BY fullname, i ORDER BY j) AS e, len(regexp_extract(m, '{units.WORD}')) AS l FROM
  (SELECT fullname, i, n, a, unnest(regexp_extract_all(line, '{space}*{units.WORD}')) AS m, generate_subscripts(regexp_extract_all(line, '{space}*{units.WORD}'), 1) - 1 AS j FROM pa WHERE n > {max_words})),
sp AS (SELECT fullname, put_a AS focus_start, put_b AS focus_end FROM pk WHERE put_a IS NOT NULL
  UNION ALL SELECT fullname, s, e FROM pk WHERE i = len(ps) AND s IS NOT NULL
  UNION ALL SELECT f.fullname, f.a + f.e - f.l, t.a + t.e FROM wd f JOIN wd t ON t.fullname = f.fullname AND t.i = f.i AND t.j = least(f.j + {max_words}, f.n) - 1 WHERE f.j % {step} = 0 AND (f.j = 0 OR f.j - {step} + {max_words} < f.n)
  UNION ALL SELECT fullname, 0, len(raw_body) FROM {rows} WHERE replace(raw_body, chr(10), '') = '')"""


_UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def _unit_name_sql(version: str) -> str:
    """The digest that a unit's id is made of, from fullname, source_revision_id, focus_field and the offsets."""
    return f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(fullname || chr(0) || source_revision_id || chr(0) || focus_field || chr(0) || focus_start::BIGINT || chr(0) || focus_end::BIGINT || chr(0) || '{version}'))"


@query(""", """ + _spans_sql("dm", 64, 16) + """ SELECT fullname, greatest(1, sum(CASE WHEN n <= 64 THEN 1 ELSE 1 + ceil((n - 64) / 48.0) END))::BIGINT AS chunks FROM dm LEFT JOIN pa USING (fullname) GROUP BY fullname""")
def chunk_count(spark, sf_dir):
    return t.document_messages(spark, sf_dir).select("fullname", units.chunk_count(F.col("raw_body"), 64, 16).alias("chunks"))


@query(""", """ + _spans_sql("dm", 64, 16) + """ SELECT fullname, CASE WHEN raw_body = '' THEN 'title' ELSE 'selftext' END AS focus_field, focus_start::BIGINT AS focus_start, focus_end::BIGINT AS focus_end FROM sp JOIN dm USING (fullname)""")
def chunk_spans(spark, sf_dir):
    return units.chunks(t.document_messages(spark, sf_dir), 64, 16).select("fullname", "focus_field", "focus_start", "focus_end")


@query(""", """ + _spans_sql("dm", 64, 16) + f""", h AS (SELECT fullname, focus_start, {_unit_name_sql("v1")} AS h FROM (SELECT *, CASE WHEN raw_body = '' THEN 'title' ELSE 'selftext' END AS focus_field FROM sp JOIN dm USING (fullname)))
SELECT fullname, focus_start::BIGINT AS focus_start, {_UUID_SQL} AS unit_id FROM h""")
def unit_identity(spark, sf_dir):
    m = t.document_messages(spark, sf_dir)
    c = units.chunks(m, 64, 16).join(m.select("fullname", "source_revision_id"), "fullname")
    return c.select("fullname", "focus_start", units.unit_id(F.col("fullname"), F.col("source_revision_id"), F.col("focus_field"), F.col("focus_start"), F.col("focus_end"), "v1").alias("unit_id"))


def _units(spark, sf_dir, snapshot="s1"):
    m = t.conversation_messages(spark, sf_dir)
    return units.search_units(m, context.ancestor_chains(m), snapshot)


_ABOVE_SQL = """up AS (SELECT f.fullname, f.raw_body, f.kind, list('[' || upper(a.kind) || ' ' || a.fullname || ']' || chr(10) || a.raw_body ORDER BY a.turn) FILTER (a.fullname IS NOT NULL) AS blocks
  FROM cm f LEFT JOIN cm a ON a.conv_id = f.conv_id AND a.turn < f.turn AND (a.turn >= f.turn - 4 OR a.turn = 0) GROUP BY f.fullname, f.raw_body, f.kind)"""


@query(f""", {_ABOVE_SQL}
SELECT fullname AS message_fullname, sha256(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) AS context_digest,
  sha256(coalesce(array_to_string(blocks, chr(10) || chr(10)) || chr(10) || chr(10), '') || '[FOCUS ' || upper(kind) || ' ' || fullname || ']' || chr(10) || raw_body) AS text_digest FROM up""")
def unit_context(spark, sf_dir):
    m = t.conversation_messages(spark, sf_dir)
    c = context.ancestor_chains(m)
    u = units.search_units(m.withColumn("raw_body", F.concat("raw_body")), c, "s1", max_words=1_000_000, overlap=0)
    whole = F.regexp_replace("context_text", r"(\[FOCUS [A-Z]+ [^ \]]+) \d+:\d+\]", "$1]")
    return u.select("message_fullname", sha_hex(F.col("context_only_text")).alias("context_digest"), sha_hex(whole).alias("text_digest"))


@query(f""", {_spans_sql("cm", 512, 64)}, {_ABOVE_SQL}, un AS (SELECT cm.fullname, source_revision_id, turn, CASE WHEN kind = 'comment' THEN 'body' WHEN cm.raw_body = '' THEN 'title' ELSE 'selftext' END AS focus_field, focus_start, focus_end,
  substr(cm.raw_body, focus_start::BIGINT + 1, (focus_end - focus_start)::BIGINT) AS focus_text, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS above FROM sp JOIN cm USING (fullname) JOIN (SELECT fullname, blocks FROM up) USING (fullname)),
h AS (SELECT *, {_unit_name_sql("v2")} AS h FROM un)
SELECT {_UUID_SQL} AS unit_id, fullname AS message_fullname, focus_field, focus_start::BIGINT AS focus_start, focus_end::BIGINT AS focus_end, sha256(focus_text || chr(0) || above || chr(0) || 'v2' || chr(0) || 'v1') AS content_hash, turn <= 4 AS context_complete FROM h""")
def search_units(spark, sf_dir):
    return _units(spark, sf_dir).select("unit_id", "message_fullname", "focus_field", "focus_start", "focus_end", "content_hash", "context_complete")


@query(""", have AS (SELECT * FROM cm WHERE turn < 3 AND NOT (turn = 1 AND conv_id % 4 = 0) AND NOT (turn = 2 AND conv_id % 5 = 0)),
cx AS (SELECT f.fullname, f.conv_id, list('[' || upper(a.kind) || ' ' || a.fullname || ']' || chr(10) || a.raw_body ORDER BY a.turn) FILTER (a.fullname IS NOT NULL) AS blocks, list(a.fullname ORDER BY a.turn) FILTER (a.fullname IS NOT NULL) AS refs
  FROM cm f LEFT JOIN have a ON a.conv_id = f.conv_id AND (a.turn <> 1 OR f.conv_id % 5 <> 0) WHERE f.turn = 3 GROUP BY f.fullname, f.conv_id)
SELECT fullname AS message_fullname, coalesce(array_to_string(refs, ','), '') AS refs, sha256(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) AS context_digest,
  CASE WHEN conv_id % 5 = 0 THEN 't1_c' || conv_id || '_2' WHEN conv_id % 4 = 0 THEN 't1_c' || conv_id || '_1' ELSE '' END AS missing, conv_id % 4 <> 0 AND conv_id % 5 <> 0 AS context_complete FROM cx""")
def corpus_context(spark, sf_dir):
    """A published corpus: the third answers are selected, the messages above them are hydrated; some of those are absent, others are tombstoned."""
    m = t.conversation_messages(spark, sf_dir)
    turn, thread = F.col("created_utc") % 1000, F.floor(F.col("created_utc") / 1000)
    hydrated = m.where((turn < 3) & ~((turn == 1) & (thread % 4 == 0)))
    ledger = m.where((turn == 2) & (thread % 5 == 0)).select(F.col("fullname").alias("message_fullname"), F.lit(None).cast("string").alias("source_revision_id"), F.lit("asked").alias("reason"))
    out = f"{publish.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    pipelines.build_corpus(m.where(turn == 3), hydrated, "s1", out, ledger, max_bytes=1 << 60, max_words=1_000_000, overlap=0)
    u = publish.published(spark, f"{out}/units")
    return u.select("message_fullname", joined("context_message_refs").alias("refs"), sha_hex(F.col("context_only_text")).alias("context_digest"), joined("missing_context_ids").alias("missing"), "context_complete")


# Full text --------------------------------------------------------------------------------------------------------------------


def _document_units(spark, sf_dir):
    d = t.document_messages(spark, sf_dir)
    return d.select(F.col("fullname").alias("unit_id"), F.lit("s1").alias("snapshot_id"), F.col("fullname").alias("message_fullname"), "source_revision_id", F.col("raw_body").alias("focus_text"), F.col("subreddit").alias("context_only_text"), F.array(F.concat(F.lit("t3_d"), (F.col("created_utc") + 1).cast("string"))).alias("context_message_refs"), sha_hex(F.col("raw_body")).alias("content_hash"))


def _postings(spark, sf_dir):
    u = _document_units(spark, sf_dir)
    return lexical.postings(u), lexical.statistics(u)


_TOKENS_SQL = """, tk AS (SELECT fullname AS unit_id, regexp_extract_all(lower(raw_body), '[\\p{L}\\p{N}]+') AS f, regexp_extract_all(lower(subreddit), '[\\p{L}\\p{N}]+') AS c FROM dm),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(f) + len(c)) AS mean FROM tk),
"""


def _tf(word: str, prefix: bool = False) -> str:
    test = f"starts_with(x, '{word}')" if prefix else f"x = '{word}'"
    return f"(len(list_filter(f, lambda x: {test})) + len(list_filter(c, lambda x: {test})))"


def _phrase_tf(words: list[str]) -> str:
    return "len(list_filter(range(1, len(f) + 1), lambda i: " + " AND ".join(f"f[i + {k}] = '{w}'" for k, w in enumerate(words)) + "))"


def _bm25_sql(tfs: list[str], where: str, limit: int = 20) -> str:
    names = [f"t{k}" for k in range(len(tfs))]
    idf = lambda k: f"greatest(ln((n - (SELECT count(*) FROM tf WHERE t{k} > 0) + 0.5) / ((SELECT count(*) FROM tf WHERE t{k} > 0) + 0.5)), 1e-6::DOUBLE)"
    score = " + ".join(f"{idf(k)} * (t{k} * 2.2::DOUBLE) / (t{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for k in range(len(tfs)))
    return (
        _TOKENS_SQL + f"tf AS (SELECT unit_id, len(f) + len(c) AS dl, {', '.join(f'{x} AS {n}' for x, n in zip(tfs, names, strict=True))} FROM tk),\n"
        f"sc AS (SELECT unit_id, -({score}) AS score FROM tf, st WHERE {where})\nSELECT unit_id, round(score, 9) AS score, row_number() OVER (ORDER BY score, unit_id)::INTEGER AS rank FROM sc ORDER BY score, unit_id LIMIT {limit}"
    )


def _ranked(spark, sf_dir, text: str, limit: int = 20) -> DataFrame:
    post, (n, mean) = _postings(spark, sf_dir)
    return lexical.top_k(lexical.bm25(post, text, n, mean), limit).select("unit_id", F.round("score", 9).alias("score"), "rank")


@query(_bm25_sql([_tf("version"), _tf("license")], "t0 > 0 AND t1 > 0"))
def bm25_search(spark, sf_dir):
    return _ranked(spark, sf_dir, "version AND license")


@query(_bm25_sql([_phrase_tf(["all", "rights", "reserved"])], "t0 > 0"))
def bm25_phrase(spark, sf_dir):
    return _ranked(spark, sf_dir, '"all rights reserved"')


@query(_bm25_sql([_tf("idiot"), _tf("moron"), _tf("clown")], "(t0 > 0 OR t1 > 0) AND NOT t2 > 0"))
def bm25_or_not(spark, sf_dir):
    return _ranked(spark, sf_dir, "(idiot OR moron) NOT clown")


@query(_bm25_sql([_tf("licen", True), _tf("the")], "t0 > 0 AND t1 > 0"))
def bm25_prefix(spark, sf_dir):
    return _ranked(spark, sf_dir, "licen* the")


@query(_TOKENS_SQL + "tf AS (SELECT unit_id, len(list_filter(c, lambda x: x = 'src3')) AS t0, " + _tf("the") + " AS t1 FROM tk) SELECT unit_id FROM tf WHERE t0 > 0 AND t1 > 0")
def match_column(spark, sf_dir):
    post, _ = _postings(spark, sf_dir)
    return lexical.match(post, "context_only_text:src3 AND the").select("unit_id")


@query(_TOKENS_SQL + "p AS (SELECT unit_id, unnest(list_filter(range(1, len(f) + 1), lambda i: f[i] = 'idiot')) AS a, f FROM tk) SELECT DISTINCT unit_id FROM p WHERE list_contains(f[greatest(1, a - 6):a + 6], 'the')")
def match_near(spark, sf_dir):
    post, _ = _postings(spark, sf_dir)
    return lexical.match(post, "NEAR(idiot the, 5)").select("unit_id")


@query(_TOKENS_SQL + "x AS (SELECT unnest(list_concat(f, c)) AS term, unit_id FROM tk) SELECT term, count(DISTINCT unit_id)::BIGINT AS units, count(*)::BIGINT AS tokens FROM x GROUP BY term ORDER BY units DESC, term LIMIT 50")
def postings_terms(spark, sf_dir):
    post, _ = _postings(spark, sf_dir)
    return post.groupBy("term").agg(F.countDistinct("unit_id").alias("units"), F.sum(F.size("positions")).cast("bigint").alias("tokens")).orderBy(F.desc("units"), "term").limit(50)


#: The stated lexical queries: scenario, number, text.
_TEXTS = [("insults", 0, "idiot"), ("insults", 1, "moron"), ("insults", 2, "stupid OR clown"), ("licences", 0, "license"), ("licences", 1, '"rights reserved"')]


def _hits(spark, sf_dir, depth: int = 30):
    post, (n, mean) = _postings(spark, sf_dir)
    return lexical.search(post, _TEXTS, n, mean, depth)


def _hit_sql(scenario: str, k: int, tfs: list[str], where: str) -> str:
    idf = lambda j: f"greatest(ln((n - (SELECT count(*) FROM tf{scenario}{k} WHERE t{j} > 0) + 0.5) / ((SELECT count(*) FROM tf{scenario}{k} WHERE t{j} > 0) + 0.5)), 1e-6::DOUBLE)"
    score = " + ".join(f"{idf(j)} * (t{j} * 2.2::DOUBLE) / (t{j} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for j in range(len(tfs)))
    return (
        f"tf{scenario}{k} AS (SELECT unit_id, len(f) + len(c) AS dl, {', '.join(f'{x} AS t{j}' for j, x in enumerate(tfs))} FROM tk),\n"
        f"h{scenario}{k} AS (SELECT '{scenario}' AS scenario_id, {k} AS query_no, unit_id, score, row_number() OVER (ORDER BY score, unit_id)::INTEGER AS rank FROM (SELECT unit_id, -({score}) AS score FROM tf{scenario}{k}, st WHERE {where}) QUALIFY rank <= 30)"
    )


_HITS_SQL = _TOKENS_SQL + ",\n".join([
    _hit_sql("insults", 0, [_tf("idiot")], "t0 > 0"), _hit_sql("insults", 1, [_tf("moron")], "t0 > 0"), _hit_sql("insults", 2, [_tf("stupid"), _tf("clown")], "t0 > 0 OR t1 > 0"),
    _hit_sql("licences", 0, [_tf("license")], "t0 > 0"), _hit_sql("licences", 1, [_phrase_tf(["rights", "reserved"])], "t0 > 0"),
    "hits AS (SELECT * FROM hinsults0 UNION ALL SELECT * FROM hinsults1 UNION ALL SELECT * FROM hinsults2 UNION ALL SELECT * FROM hlicences0 UNION ALL SELECT * FROM hlicences1)",
])


@query(_HITS_SQL + """ SELECT scenario_id, unit_id, round(score, 9) AS score, rank, position FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY score, unit_id)::INTEGER AS position FROM (
SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY scenario_id, unit_id ORDER BY score, query_no) = 1)) WHERE position <= 20""")
def scenario_merge(spark, sf_dir):
    return lexical.scenario_merge(_hits(spark, sf_dir), 20).select("scenario_id", "unit_id", F.round("score", 9).alias("score"), "rank", "position")


_PIECE = "[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+"


@query(_TOKENS_SQL + _hit_sql("sn", 0, [_tf("idiot"), _tf("moron")], "t0 > 0 OR t1 > 0") + f""", pc AS (SELECT unit_id, rank, raw_body, regexp_extract_all(raw_body, '{_PIECE}') AS ms FROM hsn0 JOIN dm ON fullname = unit_id WHERE rank <= 10),
wd AS (SELECT *, regexp_extract(m, '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT unit_id, rank, raw_body, len(ms) AS n, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS j FROM pc)),
ht AS (SELECT *, lower(w) IN ('idiot', 'moron') AS hit FROM wd), wn AS (SELECT unit_id, j, n, sum(hit::INTEGER) OVER (PARTITION BY unit_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS c FROM ht),
bs AS (SELECT unit_id, arg_min(j, j - c * 1000000) AS pos FROM wn WHERE j < greatest(1, n - 15) GROUP BY unit_id), tl AS (SELECT unit_id, sum(len(m))::BIGINT AS told FROM wd GROUP BY unit_id)
SELECT unit_id, rank, CASE WHEN pos > 0 THEN '…' ELSE '' END || string_agg(CASE WHEN j = pos THEN '' ELSE left(m, len(m) - len(w)) END || CASE WHEN hit THEN '<mark>' || w || '</mark>' ELSE w END, '' ORDER BY j) || CASE WHEN pos + 16 < n THEN '…' ELSE substr(raw_body, told + 1) END AS snippet
FROM ht JOIN bs USING (unit_id) JOIN tl USING (unit_id) WHERE j >= pos AND j < pos + 16 GROUP BY unit_id, rank, pos, n, raw_body, told""")
def search_snippets(spark, sf_dir):
    u = _document_units(spark, sf_dir)
    top = _ranked(spark, sf_dir, "idiot OR moron", 10)
    return lexical.snippets(top.join(u.select("unit_id", "focus_text"), "unit_id"), "idiot OR moron").select("unit_id", "rank", "snippet")


@query("""SELECT fullname AS unit_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN 'new' ELSE 'old' END AS generation FROM dm""")
def index_units(spark, sf_dir):
    """New units (even ids) replace old ones; blocked ones (every tenth) aren't taken in, so the old generation stays."""
    u = _document_units(spark, sf_dir).withColumn("n", F.substring("unit_id", 5, 20).cast("bigint"))
    old = u.withColumn("generation", F.lit("old"))
    new = u.where("n % 2 = 0").withColumn("generation", F.lit("new"))
    return lexical.index_units(new, old, u.where("n % 10 = 0")).select("unit_id", "generation")


# Dense ------------------------------------------------------------------------------------------------------------------------

_DOT_SQL = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COSINE_SQL = f"({_DOT_SQL.format(a='p.embedding', b='q.embedding')}) / (sqrt({_DOT_SQL.format(a='p.embedding', b='p.embedding')}) * sqrt({_DOT_SQL.format(a='q.embedding', b='q.embedding')}))"


def _dense(spark, sf_dir, k, where=None):
    p = t.points(spark, sf_dir)
    queries = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return dense.search(queries, p, k, where)


@query(f"""SELECT query_id, id, round(score, 7) AS score, rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, {_COSINE_SQL} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE_SQL} DESC, p.vec_id)::INTEGER AS rank
FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10).select("query_id", "id", F.round("score", 7).alias("score"), "rank")


@query(f"""SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE_SQL} DESC, p.vec_id)::INTEGER AS rank
FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND p.label = 3) WHERE rank <= 5""")
def dense_filtered(spark, sf_dir):
    return _dense(spark, sf_dir, 5, {"label": 3}).select("query_id", "id", "rank")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 50 = 1 THEN 'dimension' WHEN vec_id % 50 = 2 THEN 'not_finite' WHEN vec_id % 50 = 3 THEN 'zero_norm' WHEN vec_id % 50 = 4 THEN 'missing' END AS problem FROM embeddings""")
def vector_check(spark, sf_dir):
    v = F.col("vector")
    bad = F.when(F.col("id") % 50 == 1, F.slice(v, 1, 3)).when(F.col("id") % 50 == 2, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).when(F.col("id") % 50 == 3, F.transform(v, lambda x: F.lit(0.0).cast("float"))).when(F.col("id") % 50 != 4, v)
    return dense.check_vectors(t.points(spark, sf_dir).withColumn("vector", bad), 64).select("id", "problem")


@query("""SELECT (vec_id // 10)::VARCHAR AS scenario_id, round(avg(embedding[1]::DOUBLE) FILTER (vec_id % 5 = 0), 7) AS x0, round(avg(embedding[64]::DOUBLE) FILTER (vec_id % 5 = 0), 7) AS x63, count(*) FILTER (vec_id % 5 = 0)::BIGINT AS positives, count(*) FILTER (vec_id % 5 <> 0)::BIGINT AS negatives FROM embeddings GROUP BY 1""")
def feedback_centroid(spark, sf_dir):
    """A scenario for each ten vectors, of which two are positive examples."""
    s = t.points(spark, sf_dir).select(F.floor(F.col("id") / 10).cast("string").alias("scenario_id"), "id", "vector", (F.col("id") % 5 == 0).alias("positive"))
    c = dense.feedback_centroids(s, 64)
    return c.select("scenario_id", F.round(F.col("query")[0], 7).alias("x0"), F.round(F.col("query")[63], 7).alias("x63"), F.size("positives").cast("bigint").alias("positives"), F.size("negatives").cast("bigint").alias("negatives"))


@query("""SELECT fullname AS unit_id, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'failed' END AS reason FROM dm WHERE doc_id % 4 < 3""")
def index_pending(spark, sf_dir):
    u = _document_units(spark, sf_dir).withColumn("n", F.substring("unit_id", 5, 20).cast("bigint"))
    jobs = u.where("n % 4 > 0").select("snapshot_id", F.lit("r").alias("recipe_hash"), "unit_id", F.when(F.col("n") % 4 == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("n") % 4 == 2, "failed").otherwise("indexed").alias("status"))
    return dense.pending(u, jobs, "s1", "r").select("unit_id", "reason")


@query(""", u AS (SELECT doc_id % 3 <> 0 AS here, fullname IN (SELECT message_fullname FROM ts WHERE source_revision_id IS NULL) AS named, 't3_d' || (doc_id + 1) IN (SELECT message_fullname FROM ts) AS told FROM dm)
SELECT (SELECT count(DISTINCT (message_fullname, source_revision_id)) FROM ts)::BIGINT AS requested, count(*) FILTER (here AND named)::BIGINT AS deleted, count(*) FILTER (here AND told AND NOT named)::BIGINT AS context_deleted, count(*)::BIGINT AS before, count(*) FILTER (NOT here OR NOT (named OR told))::BIGINT AS after FROM u""")
def dense_deletion(spark, sf_dir):
    """Points of two snapshots, each with a reference to the next document; the ledger names toxic documents, half of them in a revision that isn't theirs."""
    u = _document_units(spark, sf_dir).withColumn("id", F.col("unit_id"))
    points = u.withColumn("snapshot_id", F.when(F.substring("unit_id", 5, 20).cast("bigint") % 3 == 0, "s0").otherwise("s1"))
    return dense.delete_points(points, t.tombstones(spark, sf_dir), "s1")[1]


@query(""", u AS (SELECT fullname, doc_id % 3 <> 0 AS here, fullname IN (SELECT message_fullname FROM ts WHERE source_revision_id IS NULL) AS named, 't3_d' || (doc_id + 1) IN (SELECT message_fullname FROM ts) AS told FROM dm)
SELECT fullname AS id FROM u WHERE NOT here OR NOT (named OR told)""")
def dense_after_deletion(spark, sf_dir):
    u = _document_units(spark, sf_dir).withColumn("id", F.col("unit_id"))
    points = u.withColumn("snapshot_id", F.when(F.substring("unit_id", 5, 20).cast("bigint") % 3 == 0, "s0").otherwise("s1"))
    return dense.delete_points(points, t.tombstones(spark, sf_dir), "s1")[0].select("id")


@query("""SELECT CASE WHEN vec_id % 2 = 0 THEN 's2' ELSE 's1' END AS snapshot_id, count(*)::BIGINT AS n FROM embeddings GROUP BY 1""")
def snapshot_repair(spark, sf_dir):
    p = t.points(spark, sf_dir).withColumn("snapshot_id", F.when(F.col("id") % 2 == 0, "s0").otherwise("s1"))
    return dense.relabelled(p, "s0", "s2").groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query("""SELECT fullname, array_to_string([(('0x' || substr(sha256(raw_body), 1 + 2 * k, 2))::INTEGER)::VARCHAR FOR k IN range(0, 8)], ',') AS bytes FROM dm""")
def hash_embeddings(spark, sf_dir):
    v = hash_embedding(F.col("raw_body"))
    return t.document_messages(spark, sf_dir).select("fullname", joined(F.transform(v, lambda x: F.round(x.cast("double") * 255).cast("int").cast("string"))).alias("bytes"))


# Fusion -----------------------------------------------------------------------------------------------------------------------


def _document_points(spark, sf_dir):
    """The points that are vectors of documents, under the names of their messages."""
    d = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).distinct()
    return t.points(spark, sf_dir).join(d, "id", "left_semi").select(F.concat(F.lit("t3_d"), F.col("id").cast("string")).alias("id"), "vector")


_POINTS_SQL = "pv AS (SELECT 't3_d' || vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"

#: How deep the branches' rankings, the fused ones and the runs go.
_DEPTH, _FUSED, _RUN = 60, 40, 40
_SCENARIO = ("scenario_id",)


def _branches(spark, sf_dir):
    """The rankings of all documents for each scenario, one for every point whose id is divisible by 100: by its kind's lexical queries, merged, and by cosine to the point."""
    hits = lexical.scenario_merge(_hits(spark, sf_dir, _DEPTH), _DEPTH)
    kind = F.when(F.col("id") % 200 == 0, "insults").otherwise("licences")
    stated = t.points(spark, sf_dir).where("id % 100 = 0").select(kind.alias("kind"), F.concat_ws("-", kind, "id").alias("query_id"), F.col("vector").alias("query"))
    words = hits.join(stated, F.col("scenario_id") == F.col("kind")).select(F.col("query_id").alias("scenario_id"), F.col("unit_id").alias("candidate_id"), F.lit("lexical").alias("branch"), F.col("position").alias("rank"), "score")
    near = dense.search(stated, _document_points(spark, sf_dir), _DEPTH)
    return words.unionByName(near.select(F.col("query_id").alias("scenario_id"), F.col("id").alias("candidate_id"), F.lit("dense").alias("branch"), "rank", "score"))


_BRANCH_SQL = _HITS_SQL.replace("rank <= 30", f"rank <= {_DEPTH}") + f""", qv AS (SELECT kind, kind || '-' || vec_id AS scenario_id, embedding FROM (SELECT *, CASE WHEN vec_id % 200 = 0 THEN 'insults' ELSE 'licences' END AS kind FROM embeddings WHERE vec_id % 100 = 0)),
lx AS (SELECT qv.scenario_id, unit_id AS candidate_id, 'lexical' AS branch, rank FROM qv JOIN (SELECT scenario_id AS kind, unit_id, row_number() OVER (PARTITION BY scenario_id ORDER BY score, unit_id) AS rank FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY scenario_id, unit_id ORDER BY score, query_no) = 1)) USING (kind)),
{_POINTS_SQL}, br AS (SELECT * FROM lx WHERE rank <= {_DEPTH} UNION ALL SELECT * FROM (SELECT scenario_id, p.id, 'dense', row_number() OVER (PARTITION BY scenario_id ORDER BY {_COSINE_SQL} DESC, p.id) AS rank FROM qv q, pv p) WHERE rank <= {_DEPTH})"""

_FUSED_SQL = f"""fu AS (SELECT scenario_id, candidate_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM br GROUP BY scenario_id, candidate_id QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY s DESC, candidate_id) <= {_FUSED})"""


@query(f"""{_BRANCH_SQL}, fu AS (SELECT scenario_id, candidate_id, sum(CASE branch WHEN 'dense' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)) AS s, string_agg(branch || ':' || rank, ',' ORDER BY branch) AS ranks FROM br GROUP BY scenario_id, candidate_id)
SELECT scenario_id, candidate_id, round(s, 9) AS rrf_score, ranks, row_number() OVER (PARTITION BY scenario_id ORDER BY s DESC, candidate_id)::INTEGER AS rank FROM fu QUALIFY rank <= {_FUSED}""")
def rrf_fusion(spark, sf_dir):
    f = fusion.rrf(_branches(spark, sf_dir), 60, {"dense": 2.0}, _FUSED, _SCENARIO)
    ranks = joined(F.transform(F.array_sort(F.map_keys("branch_ranks")), lambda k: F.concat(k, F.lit(":"), F.element_at(F.col("branch_ranks"), k).cast("string"))))
    return f.select("scenario_id", "candidate_id", F.round("rrf_score", 9).alias("rrf_score"), ranks.alias("ranks"), "rank")


@query(f"""{_BRANCH_SQL}, best AS (SELECT scenario_id, candidate_id, min(rank * 10 + CASE branch WHEN 'dense' THEN 0 ELSE 1 END) AS k FROM br GROUP BY scenario_id, candidate_id)
SELECT scenario_id, candidate_id, row_number() OVER (PARTITION BY scenario_id ORDER BY k, candidate_id)::INTEGER AS rank, (k % 10)::INTEGER AS variant FROM best QUALIFY rank <= {_FUSED}""")
def variant_merge(spark, sf_dir):
    hits = _branches(spark, sf_dir).withColumn("variant", F.when(F.col("branch") == "dense", 0).otherwise(1))
    return fusion.variant_merge(hits, _FUSED, _SCENARIO).select("scenario_id", "candidate_id", "rank", "variant")


@query(f"""{_BRANCH_SQL}, a AS (SELECT scenario_id, candidate_id, rank AS a FROM br WHERE branch = 'dense'), b AS (SELECT scenario_id, candidate_id, rank AS b FROM br WHERE branch = 'lexical'), j AS (SELECT scenario_id, candidate_id, a, b FROM a FULL JOIN b USING (scenario_id, candidate_id))
SELECT scenario_id, candidate_id, row_number() OVER (PARTITION BY scenario_id ORDER BY a IS NULL, coalesce(a, b), candidate_id)::INTEGER AS rank, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'original' ELSE 'already_seen' END AS origin FROM j QUALIFY rank <= 80""")
def feedback_union(spark, sf_dir):
    b = written(_branches(spark, sf_dir))
    return fusion.feedback_union(b.where("branch = 'dense'"), b.where("branch = 'lexical'"), 80, _SCENARIO)


_OVERLAP_SQL = "len(list_distinct(list_filter(regexp_extract_all(lower(raw_body), '[\\p{L}\\p{N}]+'), lambda x: x IN ('version', 'license', 'the'))))::DOUBLE"


@query(f"""{_BRANCH_SQL}, {_FUSED_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY s DESC, candidate_id) AS rank FROM fu),
s AS (SELECT scenario_id, candidate_id, {_OVERLAP_SQL} AS s, candidate_id IN (SELECT candidate_id FROM h WHERE rank <= 10) AS cached FROM h JOIN dm ON fullname = candidate_id)
SELECT scenario_id, candidate_id, CASE WHEN cached THEN 9.0::DOUBLE ELSE s END AS rerank_score, cached, row_number() OVER (PARTITION BY scenario_id ORDER BY CASE WHEN cached THEN 9.0 ELSE s END DESC, candidate_id)::INTEGER AS rerank_rank FROM s""")
def rerank_cached(spark, sf_dir):
    """The fused candidates of each scenario, scored anew; the first ten of each have their scores in the cache."""
    found = written(fusion.rrf(_branches(spark, sf_dir), limit=_FUSED, partition=_SCENARIO).select("scenario_id", "candidate_id", "rank"))
    texts = t.document_messages(spark, sf_dir).select(F.col("fullname").alias("candidate_id"), "raw_body")
    key = sha_hex(nul_joined("model-1", F.col("candidate_id")))
    cache = found.where("rank <= 10").select(key.alias("key"), F.lit(9.0).alias("score")).distinct()
    c = texts.join(found, "candidate_id")
    return fusion.rerank(c, fusion.overlap_score("version license the", F.col("raw_body")), _FUSED, cache, key, _SCENARIO).select("scenario_id", "candidate_id", "rerank_score", "cached", "rerank_rank")


def _variant_runs(spark, sf_dir) -> dict[str, DataFrame]:
    """The compared pipelines over all scenarios: A lexical; B both branches fused and reranked; C also a feedback pass with the mean of B's first two that have a vector."""
    b = written(_branches(spark, sf_dir))
    score = (F.substring("candidate_id", 5, 20).cast("bigint") % 17).cast("double")
    again = lambda x, limit: fusion.rerank(x, score, limit, partition=_SCENARIO).select("scenario_id", "candidate_id", F.col("rerank_rank").alias("rank"))
    fused = written(again(fusion.rrf(b, limit=_FUSED, partition=_SCENARIO), _FUSED))
    p = _document_points(spark, sf_dir)
    seeds = p.join((fused.where("rank <= 2").select("scenario_id", F.col("candidate_id").alias("id"))), "id").withColumn("positive", F.lit(True))
    centre = dense.feedback_centroids(seeds, 64).select(F.col("scenario_id").alias("query_id"), F.col("query").cast("array<float>").alias("query"))
    nearest = dense.search(written(centre), p, _FUSED).select(F.col("query_id").alias("scenario_id"), F.col("id").alias("candidate_id"), "rank")
    union = fusion.feedback_union(fused, nearest, 2 * _FUSED, _SCENARIO).select("scenario_id", "candidate_id", "rank")
    return {"A": b.where("branch = 'lexical'").select("scenario_id", "candidate_id", "rank"), "B": fused, "C": again(union, 2 * _FUSED)}


_RERANKED_SQL = "SELECT scenario_id, candidate_id, row_number() OVER (PARTITION BY scenario_id ORDER BY substr(candidate_id, 5)::BIGINT % 17 DESC, candidate_id)::INTEGER AS rank FROM"


@query(f"""{_BRANCH_SQL}, {_FUSED_SQL}, rb AS ({_RERANKED_SQL} fu),
ce AS (SELECT scenario_id, list(x ORDER BY i)::FLOAT[] AS embedding FROM (SELECT scenario_id, i, avg(v::DOUBLE) AS x FROM (SELECT scenario_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM pv JOIN rb ON id = candidate_id WHERE rank <= 2) GROUP BY scenario_id, i) GROUP BY scenario_id),
ag AS (SELECT scenario_id, p.id AS candidate_id FROM pv p, ce q QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY {_COSINE_SQL} DESC, p.id) <= {_FUSED})
SELECT 'A' AS variant, scenario_id, candidate_id, rank::INTEGER AS rank FROM br WHERE branch = 'lexical' UNION ALL SELECT 'B', scenario_id, candidate_id, rank FROM rb
UNION ALL SELECT 'C', * FROM ({_RERANKED_SQL} (SELECT scenario_id, candidate_id FROM rb UNION SELECT scenario_id, candidate_id FROM ag))""")
def compare_variants(spark, sf_dir):
    runs = [r.withColumn("variant", F.lit(v)) for v, r in _variant_runs(spark, sf_dir).items()]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query(f"{_BRANCH_SQL}, {_FUSED_SQL} {_RERANKED_SQL} fu")
def compare_fused_reranked(spark, sf_dir):
    return _variant_runs(spark, sf_dir)["B"]


# Tombstones -------------------------------------------------------------------------------------------------------------------


@query("""SELECT fullname FROM dm WHERE NOT EXISTS (SELECT 1 FROM ts WHERE message_fullname = fullname AND (ts.source_revision_id IS NULL OR ts.source_revision_id = dm.source_revision_id))""")
def tombstone_filter(spark, sf_dir):
    return tombstones.without_tombstoned(t.document_messages(spark, sf_dir), t.tombstones(spark, sf_dir)).select("fullname")


_BLOCKED_SQL = """, un AS (SELECT fullname AS unit_id, doc_id, source_revision_id, 't3_d' || (doc_id + 1) AS ref FROM dm),
bl AS (SELECT un.*, EXISTS (SELECT 1 FROM ts WHERE message_fullname = unit_id AND (ts.source_revision_id IS NULL OR ts.source_revision_id = un.source_revision_id)) AS direct, ref IN (SELECT message_fullname FROM ts) AS context FROM un)
"""


@query(_BLOCKED_SQL + "SELECT unit_id, CASE WHEN direct THEN 'direct' WHEN context THEN 'context' END AS blocked FROM bl")
def tombstone_blocks(spark, sf_dir):
    return tombstones.blocked_rows(_document_units(spark, sf_dir), t.tombstones(spark, sf_dir)).select("unit_id", "blocked")


@query(_BLOCKED_SQL + "SELECT unit_id FROM bl WHERE context")
def tombstone_context(spark, sf_dir):
    return tombstones.context_blocked(_document_units(spark, sf_dir), t.tombstones(spark, sf_dir)).select("unit_id")


def _conversation_tombstones(spark, sf_dir):
    return t.conversation_messages(spark, sf_dir).where("created_utc % 13 = 0").select(F.col("fullname").alias("message_fullname"), F.lit(None).cast("string").alias("source_revision_id"), F.lit("x").alias("reason"))


@query(""", gone AS (SELECT fullname FROM cm WHERE created_utc % 13 = 0),
refs AS (SELECT f.fullname AS unit, a.fullname AS ref FROM cm f JOIN cm a ON a.conv_id = f.conv_id AND a.turn < f.turn AND (a.turn >= f.turn - 4 OR a.turn = 0)),
d AS (SELECT count(*) AS n FROM gone), s AS (SELECT count(DISTINCT unit) AS n FROM refs WHERE ref IN (SELECT fullname FROM gone) AND unit NOT IN (SELECT fullname FROM gone))
SELECT (d.n + s.n)::BIGINT AS matched, d.n::BIGINT AS deleted, s.n::BIGINT AS scrubbed, d.n = 0 AS idempotent FROM d, s""")
def tombstone_apply(spark, sf_dir):
    return tombstones.apply_tombstones(_units(spark, sf_dir), _conversation_tombstones(spark, sf_dir), "s1")[1]


@query(""", gone AS (SELECT fullname FROM cm WHERE created_utc % 13 = 0),
up AS (SELECT f.fullname, list('[' || upper(a.kind) || ' ' || a.fullname || ']' || chr(10) || a.raw_body ORDER BY a.turn) FILTER (a.fullname IS NOT NULL AND a.fullname NOT IN (SELECT fullname FROM gone)) AS blocks,
  string_agg(a.fullname, ',' ORDER BY a.turn) FILTER (a.fullname IN (SELECT fullname FROM gone)) AS missing
  FROM cm f LEFT JOIN cm a ON a.conv_id = f.conv_id AND a.turn < f.turn AND (a.turn >= f.turn - 4 OR a.turn = 0) WHERE f.fullname NOT IN (SELECT fullname FROM gone) GROUP BY f.fullname)
SELECT fullname AS message_fullname, sha256(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) AS context_digest, len(coalesce(blocks, []))::BIGINT AS refs, coalesce(array_length(str_split(missing, ',')), 0)::BIGINT AS missing FROM up""")
def tombstone_scrub(spark, sf_dir):
    after = tombstones.apply_tombstones(_units(spark, sf_dir), _conversation_tombstones(spark, sf_dir), "s1")[0]
    return after.select("message_fullname", sha_hex(F.col("context_only_text")).alias("context_digest"), F.size("context_message_refs").cast("bigint").alias("refs"), F.size("missing_context_ids").cast("bigint").alias("missing"))


@query("""SELECT artifact, CASE WHEN artifact = 'artifact-9' THEN 'missing' WHEN sum(hit) > 0 THEN 'stale' ELSE 'clean' END AS status, sum(hit)::BIGINT AS matched FROM (
SELECT 'artifact-' || (doc_id % 4) AS artifact, (EXISTS (SELECT 1 FROM ts WHERE message_fullname = fullname AND (ts.source_revision_id IS NULL OR ts.source_revision_id = dm.source_revision_id)))::INTEGER AS hit FROM dm UNION ALL SELECT 'artifact-9', 0) GROUP BY artifact""")
def artifact_audit(spark, sf_dir):
    refs = t.document_messages(spark, sf_dir).select(F.concat(F.lit("artifact-"), (F.col("created_utc") % 4).cast("string")).alias("artifact"), F.col("fullname").alias("message_fullname"), "source_revision_id")
    expected = spark.createDataFrame([(f"artifact-{k}",) for k in (0, 1, 2, 3, 9)], "artifact string")
    return tombstones.artifact_audit(refs, t.tombstones(spark, sf_dir), expected)


@query("""SELECT count(*)::BIGINT AS records, sha256(string_agg(message_fullname || chr(0) || coalesce(source_revision_id, '') || chr(0) || reason, chr(10) ORDER BY message_fullname, source_revision_id NULLS FIRST)) AS digest FROM ts""")
def ledger_digest(spark, sf_dir):
    return tombstones.ledger_digest(t.tombstones(spark, sf_dir))


@query("""SELECT message_fullname, source_revision_id, row_number() OVER (ORDER BY message_fullname) % 2 = 0 AND false OR try_cast(substr(message_fullname, 5) AS BIGINT) % 4 = 0 AS already_applied FROM ts""")
def suppression_precheck(spark, sf_dir):
    led = t.tombstones(spark, sf_dir)
    return tombstones.precheck(led, led.where("cast(substring(message_fullname, 5) AS bigint) % 4 = 0")).select("message_fullname", "source_revision_id", "already_applied")


@query("""SELECT message_fullname, CASE WHEN n % 3 = 0 THEN 'bad_name' WHEN n % 5 = 0 THEN 'no_reason' WHEN n % 7 = 0 THEN 'duplicate' END AS problem FROM (
SELECT CASE WHEN n % 3 = 0 THEN 'x' || n ELSE message_fullname END AS message_fullname, n FROM (SELECT *, substr(message_fullname, 5)::BIGINT AS n FROM ts) UNION ALL SELECT message_fullname, n FROM (SELECT *, substr(message_fullname, 5)::BIGINT AS n FROM ts) WHERE n % 7 = 0 AND n % 3 <> 0)""")
def ledger_check(spark, sf_dir):
    led = t.tombstones(spark, sf_dir).withColumn("n", F.substring("message_fullname", 5, 20).cast("bigint"))
    rows = led.withColumn("message_fullname", F.when(F.col("n") % 3 == 0, F.concat(F.lit("x"), F.col("n").cast("string"))).otherwise(F.col("message_fullname"))).withColumn("reason", F.when(F.col("n") % 5 == 0, " ").otherwise(F.col("reason")))
    rows = rows.unionByName(rows.where("n % 7 = 0 AND n % 3 <> 0"))
    return tombstones.checked_ledger(rows).select("message_fullname", "problem")


# Similarity -------------------------------------------------------------------------------------------------------------------

_SHINGLES_SQL = """, w AS (SELECT fullname AS id, regexp_extract_all(lower(raw_body), '[\\p{L}\\p{N}_]+') AS w FROM dm), lw AS (SELECT * FROM w WHERE len(w) >= 5),
g AS (SELECT array_to_string(w, ' ') AS joined, min(id) AS first, count(*) AS n FROM lw GROUP BY 1),
f AS (SELECT lw.id, lw.w FROM lw JOIN g ON lw.id = g.first), sh AS (SELECT DISTINCT id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM f)), sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pr AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT a, b, c::DOUBLE / (x.n + y.n - c) AS j FROM pr JOIN sz x ON x.id = a JOIN sz y ON y.id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.9),
exact AS (SELECT g.first AS a, lw.id AS b FROM lw JOIN g ON array_to_string(lw.w, ' ') = g.joined WHERE lw.id <> g.first)
"""


def _pool_texts(spark, sf_dir):
    return t.document_messages(spark, sf_dir).select(F.col("fullname").alias("candidate_id"), F.col("raw_body").alias("text"))


@query(_SHINGLES_SQL + "SELECT a, b FROM exact")
def exact_duplicates(spark, sf_dir):
    return similarity.exact_pairs(similarity.shingled(_pool_texts(spark, sf_dir)))


@query(_SHINGLES_SQL + "SELECT a, b, round(j, 9) AS jaccard FROM near")
def near_duplicates(spark, sf_dir):
    s = similarity.shingled(_pool_texts(spark, sf_dir), unicode=False)
    return similarity.near_pairs(s).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


_GROUPS_SQL = _SHINGLES_SQL.replace("exact AS (", "exact AS (", 1) + """, ed AS (SELECT a, b FROM exact UNION SELECT a, b FROM near), both_ways AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach(id, root) AS (SELECT fullname, fullname FROM dm UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), mem AS (SELECT root, 'group-' || substr(sha256(string_agg(id, chr(0) ORDER BY id)), 1, 16) AS group_id, count(*) AS n FROM roots GROUP BY root)
"""


def _groups(spark, sf_dir):
    pool = t.document_messages(spark, sf_dir).select(F.col("fullname").alias("candidate_id"), "thread_fullname")
    return pool, written(similarity.groups(pool, similarity.duplicate_edges(_pool_texts(spark, sf_dir), unicode=False)))


@query(_GROUPS_SQL + "SELECT id AS candidate_id, group_id, n::INTEGER AS group_size FROM roots JOIN mem USING (root)")
def duplicate_groups(spark, sf_dir):
    return _groups(spark, sf_dir)[1]


@query(_GROUPS_SQL + "SELECT n::INTEGER AS group_size, count(*)::BIGINT AS n FROM mem GROUP BY 1")
def group_sizes(spark, sf_dir):
    g = _groups(spark, sf_dir)[1].select("group_id", "group_size").distinct()
    return g.groupBy("group_size").agg(F.count("*").alias("n"))


_SPLIT_SQL = _GROUPS_SQL + """, forced AS (SELECT DISTINCT root FROM roots WHERE substr(id, 5)::BIGINT % 50 = 0),
ord AS (SELECT root, group_id, n, row_number() OVER (ORDER BY sha256('20260912' || chr(0) || 'group' || chr(0) || group_id)) AS k FROM mem WHERE root NOT IN (SELECT root FROM forced)),
tgt AS (SELECT round_even(count(*) * 0.5, 0)::BIGINT AS target FROM dm),
fold(k, total, took, root) AS (SELECT 0::BIGINT, 0::BIGINT, false, NULL::VARCHAR UNION ALL SELECT ord.k, CASE WHEN fits THEN total + n ELSE total END, fits, ord.root FROM (
  SELECT ord.*, total, total < target AND (total + n <= target OR total = 0) AS fits FROM fold JOIN ord ON ord.k = fold.k + 1, tgt) ord)
"""


@query(_SPLIT_SQL + "SELECT id AS candidate_id, group_id, CASE WHEN root IN (SELECT root FROM fold WHERE took) THEN 'test' ELSE 'dev' END AS split FROM roots JOIN mem USING (root)")
def group_split(spark, sf_dir):
    pool, g = _groups(spark, sf_dir)
    forced = pool.where("cast(substring(candidate_id, 5) AS bigint) % 50 = 0")
    return similarity.group_split(pool, g, SEED, 0.5, forced)


@query(_SPLIT_SQL + """SELECT group_id, count(DISTINCT split)::BIGINT AS splits FROM (
  SELECT group_id, CASE WHEN substr(id, 5)::BIGINT % 10 = 3 THEN 'test' WHEN root IN (SELECT root FROM fold WHERE took) THEN 'test' ELSE 'dev' END AS split FROM roots JOIN mem USING (root)) GROUP BY group_id HAVING splits > 1""")
def split_leaks(spark, sf_dir):
    """Groups that cross splits. A sound split has none, so every tenth message is moved to the test side first."""
    moved = F.when(F.substring("candidate_id", 5, 20).cast("bigint") % 10 == 3, "test").otherwise(F.col("split"))
    return similarity.crossing_groups(group_split(spark, sf_dir).withColumn("split", moved))


@query(""", w AS (SELECT fullname AS id, regexp_extract_all(replace(lower(raw_body), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS w FROM dm UNION ALL SELECT 'b' || item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') FROM benchmark),
sh AS (SELECT DISTINCT id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)), sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pr AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s WHERE a.id LIKE 't3%' AND b.id LIKE 'b%' GROUP BY 1, 2)
SELECT DISTINCT a AS candidate_id FROM pr JOIN sz x ON x.id = a JOIN sz y ON y.id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.2""")
def development_exposure(spark, sf_dir):
    dev = t.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    return similarity.exposed(_pool_texts(spark, sf_dir), dev, threshold=0.2)


@query(""", ed AS (SELECT fullname AS a, parent_fullname AS b FROM cm WHERE parent_fullname IS NOT NULL)
SELECT thread_fullname AS thread, count(*)::BIGINT AS nodes, count(*) FILTER (created_utc % 17 = 0)::BIGINT AS exposed, count(DISTINCT CASE WHEN conv_id % 2 = 0 THEN 'dev' ELSE 'test' END)::BIGINT AS splits FROM cm GROUP BY 1""")
def grouping_audit(spark, sf_dir):
    m = t.conversation_messages(spark, sf_dir)
    edges = m.where("parent_fullname IS NOT NULL").select(F.col("fullname").alias("a"), F.col("parent_fullname").alias("b"), F.lit("parent").alias("relation"))
    split = m.select("fullname", F.when(F.floor(F.col("created_utc") / 1000) % 2 == 0, "dev").otherwise("test").alias("split"))
    a = similarity.grouping_audit(m.select("fullname"), edges, split, m.where("created_utc % 17 = 0").select("fullname"))
    thread = F.concat(F.lit("t3_c"), F.regexp_extract("root", r"^t\d_c(\d+)", 1))
    return a.select(thread.alias("thread"), "nodes", "exposed", F.size("splits").cast("bigint").alias("splits"))


@query(""", w AS (SELECT fullname AS id, regexp_extract_all(replace(lower(raw_body), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS w FROM dm), sh AS (SELECT DISTINCT id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
f AS (SELECT s, min(id) AS a FROM sh GROUP BY s) SELECT 'shared_shingle' AS relation, count(*)::BIGINT AS edges FROM (SELECT DISTINCT a, id FROM sh JOIN f USING (s) WHERE id <> a)""")
def shared_shingle_groups(spark, sf_dir):
    e = similarity.shared_shingle_edges(_pool_texts(spark, sf_dir))
    return e.groupBy("relation").agg(F.count("*").alias("edges"))


# Pools, review, labels ----------------------------------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    """A run for each stated query point (ids divisible by 100): the documents nearest to it of all that have a vector. Some are in several runs."""
    stated = t.points(spark, sf_dir).where("id % 100 = 0").select(F.concat(F.lit("s-"), F.col("id").cast("string")).alias("query_id"), F.col("vector").alias("query"))
    found = dense.search(stated, _document_points(spark, sf_dir), _RUN)
    return found.select(F.col("id").alias("candidate_id"), F.col("query_id").alias("scenario_id"), "rank", F.concat("query_id", F.lit(".jsonl")).alias("run"), "score")


_RUNS_SQL = f""", {_POINTS_SQL}, rn AS (SELECT p.id AS candidate_id, 's-' || q.vec_id AS scenario_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE_SQL} DESC, p.id) AS rank FROM embeddings q, pv p WHERE q.vec_id % 100 = 0 QUALIFY rank <= {_RUN})"""

_POOL_SQL = _RUNS_SQL + """, ct AS (SELECT thread_fullname AS candidate_id FROM cm WHERE turn = 0 UNION SELECT candidate_id FROM rn WHERE scenario_id = 's-0'), ctl AS (SELECT candidate_id, sha256('20260912' || chr(0) || 'control' || chr(0) || candidate_id) AS k FROM ct WHERE candidate_id NOT IN (SELECT candidate_id FROM rn)),
room AS (SELECT 90 - least(count(*), 30) AS room FROM ctl),
rk AS (SELECT *, row_number() OVER (ORDER BY sha256('20260912' || chr(0) || 'ranked' || chr(0) || candidate_id || chr(0) || scenario_id), candidate_id, scenario_id) AS o FROM rn),
a AS (SELECT rk.* FROM rk, room WHERE o <= room), b AS (SELECT candidate_id, row_number() OVER (ORDER BY k, candidate_id) AS o FROM ctl),
pl AS (SELECT candidate_id, scenario_id, CASE WHEN rank <= 3 THEN 'strong' ELSE 'adjacent' END AS stratum, false AS is_control, rank, o FROM a UNION ALL SELECT candidate_id, NULL, 'unknown', true, NULL, o FROM b WHERE o <= 90 - (SELECT count(*) FROM a)),
pool AS (SELECT *, row_number() OVER (ORDER BY is_control, o) AS pool_order FROM pl)
"""


def _pool(spark, sf_dir):
    r = written(_runs(spark, sf_dir))
    controls = t.conversation_messages(spark, sf_dir).where("kind = 'submission'").select(F.col("fullname").alias("candidate_id")).unionByName(r.where("scenario_id = 's-0'").select("candidate_id"))
    return pooling.blinded_pool(r, controls, 90, SEED)


@query(_POOL_SQL + "SELECT printf('pool-%04d', pool_order) AS pool_id, candidate_id, scenario_id, stratum, is_control, rank::BIGINT AS rank FROM pool")
def blinded_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("pool_id", "candidate_id", "scenario_id", "stratum", "is_control", "rank")


@query(_POOL_SQL + "SELECT stratum, CASE WHEN is_control THEN 'control' ELSE 'ranked' END AS source_kind, count(*)::BIGINT AS n FROM pool GROUP BY 1, 2")
def pool_key(spark, sf_dir):
    return pooling.pool_key(_pool(spark, sf_dir)).groupBy("stratum", "source_kind").agg(F.count("*").alias("n"))


@query(_POOL_SQL + "SELECT printf('pool-%04d', pool_order) AS pool_id, pool_order::INTEGER AS pool_order, candidate_id, scenario_id FROM pool")
def reviewer_rows(spark, sf_dir):
    return pooling.reviewer_rows(_pool(spark, sf_dir))


@query(_POOL_SQL + ", tn AS (SELECT *, row_number() OVER (PARTITION BY is_control ORDER BY pool_order) AS turn FROM pool) SELECT candidate_id, scenario_id, row_number() OVER (ORDER BY turn, is_control)::INTEGER AS card_order FROM tn")
def pool_interleave(spark, sf_dir):
    return pooling.interleaved(_pool(spark, sf_dir)).select("candidate_id", "scenario_id", "card_order")


@query(_POOL_SQL + "SELECT candidate_id, scenario_id, CASE WHEN candidate_id LIKE 't3_d%' THEN candidate_id ELSE 'kept:' || candidate_id END AS message_fullname FROM pool")
def retained_sources(spark, sf_dir):
    p = _pool(spark, sf_dir)
    kept = p.where("is_control").select("candidate_id", F.concat(F.lit("kept:"), "candidate_id").alias("message_fullname")).distinct()
    return pooling.retained_sources(p, _document_units(spark, sf_dir), kept).select("candidate_id", "scenario_id", "message_fullname")


@query(_POOL_SQL + "SELECT candidate_id, scenario_id, sha256(CASE WHEN is_control THEN coalesce(nullif(cm.raw_body, ''), 'title') ELSE dm.raw_body END) AS text_digest FROM pool LEFT JOIN dm ON dm.fullname = candidate_id LEFT JOIN cm ON cm.fullname = candidate_id")
def pool_source_text(spark, sf_dir):
    d = t.document_messages(spark, sf_dir).select(F.col("fullname").alias("candidate_id"), F.col("raw_body").alias("focus_text"))
    c = t.conversation_messages(spark, sf_dir).select(F.col("fullname").alias("candidate_id"), "raw_body", F.lit("title").alias("raw_title"))
    rows = _pool(spark, sf_dir).join(d, "candidate_id", "left").join(c, "candidate_id", "left")
    return pooling.source_text(rows).select("candidate_id", "scenario_id", sha_hex(F.col("source_text")).alias("text_digest"))


@query("""SELECT fullname, CASE WHEN doc_id % 3 = 0 THEN false WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS context_complete FROM dm""")
def context_completeness(spark, sf_dir):
    n = F.col("created_utc")
    c = pooling.context_complete(F.when(n % 5 != 0, n % 2 == 0), F.lit(None).cast("boolean"), n % 3 == 0, F.lit(None).cast("array<string>"))
    return t.document_messages(spark, sf_dir).select("fullname", c.alias("context_complete"))


def _cards(spark, sf_dir):
    found = messages.discover(t.document_messages(spark, sf_dir), RULES)
    return review.cards(found, stable_rank(SEED, F.col("fullname")))


_CARD_SQL = f", crd AS (SELECT fullname AS candidate_id, list_filter([CASE WHEN {_RULE_SQL} THEN 'licence' END, CASE WHEN {_INSULT_SQL} THEN 'insult' END], lambda x: x IS NOT NULL) AS rules, row_number() OVER (ORDER BY sha256('20260912' || chr(0) || fullname)) AS o, raw_body, source_revision_id FROM dm WHERE ({_RULE_SQL}) OR {_INSULT_SQL})"


@query(_CARD_SQL + " SELECT candidate_id, o::BIGINT AS selection_order, array_to_string(rules, ',') AS rules, sha256(raw_body) AS text_digest FROM crd")
def review_cards(spark, sf_dir):
    return _cards(spark, sf_dir).select("candidate_id", "selection_order", joined("matched_rule_ids").alias("rules"), sha_hex(F.col("source.text")).alias("text_digest"))


_QUEUE_SQL = _CARD_SQL + """, br AS (SELECT candidate_id, o, unnest(rules) AS rule FROM crd), cnt AS (SELECT rule, count(*) AS n, row_number() OVER (ORDER BY count(*), rule) AS step FROM br GROUP BY rule), nr AS (SELECT count(*) AS k FROM cnt),
q1 AS (SELECT candidate_id, o, rule, 1 AS step FROM br JOIN cnt USING (rule), nr WHERE step = 1 QUALIFY row_number() OVER (ORDER BY o) <= 31 // k + (31 % k >= 1)::INTEGER),
q2 AS (SELECT candidate_id, o, rule, 2 AS step FROM br JOIN cnt USING (rule), nr WHERE step = 2 AND candidate_id NOT IN (SELECT candidate_id FROM q1) QUALIFY row_number() OVER (ORDER BY o) <= 31 // k + (31 % k >= 2)::INTEGER),
qq AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2), fill AS (SELECT candidate_id, o, NULL AS rule, 3 AS step FROM crd WHERE candidate_id NOT IN (SELECT candidate_id FROM qq) QUALIFY row_number() OVER (ORDER BY o) <= 31 - (SELECT count(*) FROM qq)),
qu AS (SELECT candidate_id, rule AS rule_id, row_number() OVER (ORDER BY step, o)::BIGINT AS queue_order FROM (SELECT * FROM qq UNION ALL SELECT * FROM fill))
"""


@query(_QUEUE_SQL + "SELECT candidate_id, queue_order, rule_id FROM qu")
def review_queue(spark, sf_dir):
    return review.balanced_queue(written(_cards(spark, sf_dir)), 31).select("candidate_id", "queue_order", "rule_id")


@query(_QUEUE_SQL + "SELECT candidate_id, queue_order, 'pending' AS review_status FROM qu")
def review_worksheet(spark, sf_dir):
    return review.worksheet(review.balanced_queue(written(_cards(spark, sf_dir)), 31)).select("candidate_id", "queue_order", "review_status")


def _drafts(card_rows):
    """Machine drafts of the cards, some of them wrong, by selection order."""
    o = F.col("selection_order")
    text = F.col("source.text")
    quote = F.when(o % 7 == 0, F.lit("not there")).otherwise(F.substring(text, 2, 4))
    end = F.when(o % 11 == 0, F.length(text) + 1).otherwise(F.lit(5)).cast("bigint")
    item = F.struct(F.when(o % 13 == 0, "t3_other").otherwise(F.col("source.message_fullname")).alias("message_fullname"), "source.source_revision_id", F.col("source.field").alias("field"), F.lit(1).cast("bigint").alias("start"), end.alias("end"), quote.alias("quote"), F.lit("topic_fit").alias("supports"), F.lit("focal_author").alias("attribution"))
    fit = F.when(o % 4 == 0, "relevant").when(o % 4 == 1, "uncertain").when(o % 4 == 2, "not_relevant").otherwise("odd")
    evidence = F.when(o % 8 == 0, F.array().cast(f"array<{'struct<message_fullname:string,source_revision_id:string,field:string,start:bigint,end:bigint,quote:string,supports:string,attribution:string>'}>")).otherwise(F.array(item))
    return card_rows.where(o % 9 != 0).select("candidate_id", "scenario_id", fit.alias("topic_fit"), evidence.alias("evidence"), o.alias("row"))


_DRAFT_SQL = _CARD_SQL + """, dr AS (SELECT candidate_id, o, CASE o % 4 WHEN 0 THEN 'relevant' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'not_relevant' ELSE 'odd' END AS topic_fit,
  CASE WHEN o % 8 = 0 THEN NULL WHEN o % 13 = 0 THEN 'message' WHEN o % 11 = 0 THEN 'end' WHEN o % 7 = 0 OR length(raw_body) < 5 THEN 'quote' END AS bad, o % 8 = 0 AS none FROM crd WHERE o % 9 <> 0),
va AS (SELECT candidate_id, o, concat_ws(',', CASE WHEN none AND topic_fit = 'relevant' THEN 'no_evidence' END, bad) AS failures FROM dr UNION ALL SELECT candidate_id, o, 'missing' FROM crd WHERE o % 9 = 0)
"""


@query(_DRAFT_SQL + "SELECT candidate_id, CASE WHEN failures = '' THEN 'valid' ELSE 'invalid' END AS validation_status, failures FROM va")
def validate_drafts(spark, sf_dir):
    c = written(_cards(spark, sf_dir))
    return review.validate_drafts(c, _drafts(c)).select("candidate_id", "validation_status", joined("failures").alias("failures"))


@query(_DRAFT_SQL + """, vs AS (SELECT candidate_id, o, CASE WHEN failures = '' THEN 'valid' ELSE 'invalid' END AS v FROM va WHERE o % 5 <> 0),
tr AS (SELECT crd.candidate_id, topic_fit, CASE WHEN dr.candidate_id IS NULL THEN 'missing_draft' WHEN v IS NULL THEN 'missing_validation' WHEN v <> 'valid' THEN 'invalid_evidence' WHEN topic_fit IN ('relevant', 'uncertain') THEN 'model_' || topic_fit
  WHEN topic_fit = 'not_relevant' AND (('0x' || substr(sha256('20260912' || chr(0) || crd.candidate_id || chr(0)), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE < 0.3 THEN 'seeded_negative_audit' WHEN topic_fit = 'not_relevant' THEN 'validated_negative' ELSE 'invalid_topic_fit' END AS reason
  FROM crd LEFT JOIN dr USING (candidate_id) LEFT JOIN vs ON vs.candidate_id = crd.candidate_id)
SELECT candidate_id, CASE reason WHEN 'seeded_negative_audit' THEN 'negative_audit' WHEN 'validated_negative' THEN 'not_selected' ELSE 'human_review' END AS triage_status, reason, topic_fit AS model_topic_fit FROM tr""")
def triage(spark, sf_dir):
    c = written(_cards(spark, sf_dir))
    d = _drafts(c)
    v = review.validate_drafts(c, d).join(c.select("candidate_id", "selection_order"), "candidate_id").where("selection_order % 5 <> 0")
    return review.triage(c, d, v, SEED, 0.3).select("candidate_id", "triage_status", "reason", "model_topic_fit")


@query(_POOL_SQL + "SELECT candidate_id, scenario_id, 'unknown' AS topic_fit, 'human' AS evaluator_kind FROM pool")
def label_stubs(spark, sf_dir):
    return labels.stubs(_pool(spark, sf_dir)).select("candidate_id", "scenario_id", "topic_fit", "evaluator_kind")


@query(_POOL_SQL + """, lb AS (SELECT pool_order AS o, candidate_id, scenario_id FROM pool WHERE pool_order % 6 <> 0 UNION ALL SELECT 1000 + pool_order, candidate_id, scenario_id FROM pool WHERE pool_order % 20 = 1 UNION ALL SELECT 5000, 'stranger', 's-0'),
ck AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, scenario_id ORDER BY o) > 1 AS dup, EXISTS (SELECT 1 FROM pool p WHERE p.candidate_id = lb.candidate_id AND p.scenario_id IS NOT DISTINCT FROM lb.scenario_id) AS inside FROM lb)
SELECT candidate_id, scenario_id, CASE WHEN o % 10 = 3 THEN 'topic_fit' WHEN o % 14 = 2 THEN concat_ws(',', 'compatible_without_claims') ELSE concat_ws(',', CASE WHEN dup THEN 'duplicate' END, CASE WHEN o % 15 = 4 THEN 'unverified_claim' END, CASE WHEN NOT inside THEN 'not_in_pool' END) END AS failures FROM ck
UNION ALL SELECT candidate_id, scenario_id, 'missing' FROM pool WHERE pool_order % 6 = 0""")
def label_import(spark, sf_dir):
    p = written(_pool(spark, sf_dir))
    o = F.col("row")
    stem = p.select("candidate_id", "scenario_id", F.col("pool_order").cast("bigint").alias("row"))
    rows = stem.where("row % 6 <> 0").unionByName(stem.where("row % 20 = 1").withColumn("row", o + 1000)).unionByName(spark.createDataFrame([("stranger", "s-0", 5000)], "candidate_id string, scenario_id string, row bigint"))
    filled = rows.select("*", F.when(o % 10 == 3, "maybe").otherwise("yes").alias("topic_fit"), F.lit("unknown").alias("speaker_intent"), F.when((o % 10 != 3) & ((o % 14 == 2) | (o % 15 == 4)), "compatible").otherwise("not_evaluated").alias("product_fit"), F.lit("unknown").alias("resolution_in_available_context"), F.lit("human").alias("evaluator_kind"), F.when(o % 14 == 2, F.array().cast("array<string>")).when(o % 15 == 4, F.array(F.lit("c1"), F.lit("c9"))).alias("supported_claim_ids"))
    return labels.import_labels(p, filled, ["c1", "c2"]).select("candidate_id", "scenario_id", joined("failures").alias("failures"))


@query(_QUEUE_SQL + "SELECT candidate_id, CASE queue_order % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS topic_fit, CASE queue_order % 2 WHEN 0 THEN 'clear' ELSE 'needs_clarification' END AS need_clarity FROM qu WHERE queue_order % 4 <> 0")
def worksheet_labels(spark, sf_dir):
    q = review.balanced_queue(written(_cards(spark, sf_dir)), 31)
    o = F.col("queue_order")
    done = q.withColumn("review_status", F.when(o % 4 == 0, "pending").otherwise("done")).withColumn("topic_fit", F.when(o % 3 == 0, "relevant").when(o % 3 == 1, "not_relevant").otherwise("uncertain")).withColumn("need_clarity", F.when(o % 2 == 0, "clear").otherwise("unclear"))
    return labels.from_worksheet(done).select("candidate_id", "topic_fit", "need_clarity")


@query("""SELECT 't3_d' || doc_id AS candidate_id, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS topic_fit, CASE WHEN doc_id % 5 = 0 THEN 't3_d' || (doc_id + 1) END AS duplicate_of FROM labels WHERE doc_id % 7 <> 0""")
def legacy_labels(spark, sf_dir):
    n = F.col("doc_id")
    rows = t.read(spark, sf_dir, "labels").select(F.concat(F.lit("t3_d"), n.cast("string")).alias("candidate_id"), F.when(n % 3 == 0, "YES").when(n % 3 == 1, "not_relevant").otherwise("perhaps").alias("label"), F.when(n % 7 == 0, "pending").alias("status"), F.lit("").alias("note"), F.when(n % 5 == 0, F.concat(F.lit("t3_d"), (n + 1).cast("string"))).alias("duplicate_of"))
    found, _, links = labels.from_legacy(rows)
    return found.join(links, "candidate_id", "left").select("candidate_id", "topic_fit", "duplicate_of")


@query(_POOL_SQL + """, ll AS (SELECT pool_order AS o, * EXCLUDE (o) FROM pool)
SELECT reason AS skip_reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o % 8 = 7 THEN 'non_human_label' WHEN o % 9 = 8 THEN 'target_task_missing' WHEN o % 10 = 9 THEN 'rubric_mismatch' WHEN o % 6 = 5 THEN 'context_dependency_identity_mismatch' WHEN o % 7 = 6 THEN 'source_fingerprint_mismatch' ELSE 'reused' END AS reason FROM ll) GROUP BY 1""")
def label_reuse(spark, sf_dir):
    p = written(_pool(spark, sf_dir))
    o = F.col("pool_order")
    side = lambda x, f: p.select("candidate_id", "scenario_id", "pool_order", x.alias("context_identity"), f.alias("fingerprint"))
    source = side(F.lit("c"), F.lit("f"))
    target = side(F.when(o % 6 == 5, "other").otherwise("c"), F.when(o % 7 == 6, "other").otherwise("f")).where("pool_order % 9 <> 8")
    given = p.select("candidate_id", "scenario_id", o.alias("row"), F.when(o % 8 == 7, "model").otherwise("human").alias("evaluator_kind"), F.when(o % 10 == 9, "old").otherwise("v1").alias("rubric_version"))
    return labels.reuse(source, given, target, "v1").groupBy(F.coalesce("skip_reason", F.lit("reused")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query(_RUNS_SQL + ", one AS (SELECT candidate_id, count(*) AS n, min(scenario_id) AS s FROM rn GROUP BY candidate_id) SELECT candidate_id, CASE WHEN n = 1 THEN s END AS scenario_id FROM one")
def scenario_resolution(spark, sf_dir):
    r = _runs(spark, sf_dir)
    bare = r.select("candidate_id").distinct().withColumn("scenario_id", F.lit(None).cast("string"))
    return labels.with_scenario(bare, r)


@query(_POOL_SQL + "SELECT field, CASE field WHEN 'snapshot_id' THEN (SELECT count(*) FROM pool) WHEN 'app_id' THEN (SELECT count(scenario_id) FROM pool) ELSE 0 END::BIGINT AS known FROM (SELECT unnest(['snapshot_id', 'app_id', 'app_profile_version', 'app_profile_sha256', 'message_fullname', 'source_revision_id', 'context_recipe_version', 'chunking_version', 'rubric_version', 'content_hash']) AS field)")
def identity_coverage(spark, sf_dir):
    return labels.identity_coverage(_pool(spark, sf_dir).withColumn("snapshot_id", F.lit("s1")).withColumn("app_id", F.col("scenario_id")))


# Metrics and findings -----------------------------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    """The runs as a pool of all tasks but every fifth rank, with labels by the candidate's number."""
    r = written(_runs(spark, sf_dir)).withColumn("n", F.substring("candidate_id", 5, 20).cast("bigint"))
    pool = r.where("rank % 5 <> 0").select("candidate_id", "scenario_id", F.when(F.col("rank") % 4 == 0, "unknown").otherwise("adjacent").alias("stratum"))
    given = r.where("n % 3 <> 0").select("candidate_id", "scenario_id", F.when(F.col("n") % 7 == 0, "unknown").when(F.col("n") % 2 == 0, "yes").otherwise("no").alias("topic_fit"), F.when(F.col("n") % 11 == 0, "model").otherwise("human").alias("evaluator_kind"), F.concat(F.lit("v"), (F.col("n") % 2).cast("string")).alias("evaluator_version"))
    run = metrics.positions(r.select("candidate_id", "scenario_id", "rank", (F.col("n") % 10 != 0).alias("context_complete")))
    return run, pool, given


_JUDGED_SQL = _RUNS_SQL + """, rj AS (SELECT *, substr(candidate_id, 5)::BIGINT AS n FROM rn), pj AS (SELECT * FROM rj WHERE rank % 5 <> 0), lj AS (SELECT candidate_id, scenario_id, CASE WHEN n % 7 = 0 THEN 'unknown' WHEN n % 2 = 0 THEN 'yes' ELSE 'no' END AS topic_fit, n FROM rj WHERE n % 3 <> 0 AND n % 11 <> 0),
vj AS (SELECT lj.candidate_id, lj.scenario_id, topic_fit AS verdict FROM lj JOIN pj USING (candidate_id, scenario_id) WHERE topic_fit <> 'unknown'),
mj AS (SELECT rj.scenario_id, count(*) AS returned, count(verdict) AS judged, count(*) FILTER (verdict = 'yes') AS relevant, count(*) FILTER (verdict IS NULL) AS unjudged, count(*) FILTER (rj.rank % 5 = 0) AS outside_pool, count(*) FILTER (verdict = 'yes' AND rj.rank <= 20) AS sr, count(*) FILTER (rj.rank <= 20) AS sl,
  min(rj.rank) FILTER (verdict = 'yes') AS fr, count(*) FILTER (rj.rank % 4 = 0 AND rj.rank % 5 <> 0) AS context_missing, count(*) FILTER (rj.n % 10 = 0) AS context_truncated FROM rj LEFT JOIN vj ON vj.candidate_id = rj.candidate_id AND vj.scenario_id = rj.scenario_id {where} GROUP BY rj.scenario_id),
pr AS (SELECT scenario_id, count(*) AS pool_relevant FROM vj WHERE verdict = 'yes' GROUP BY 1)
"""

_METRICS_SQL = """SELECT scenario_id, returned::BIGINT AS returned, judged::BIGINT AS judged, relevant::BIGINT AS relevant, unjudged::BIGINT AS unjudged, outside_pool::BIGINT AS outside_pool, round(relevant / nullif(judged, 0), 9) AS precision_judged, CASE WHEN judged = returned THEN relevant / returned END AS precision_returned,
  round(judged / returned, 9) AS judgement_coverage, CASE WHEN sl >= 20 THEN sr / 20.0::DOUBLE END AS precision_slots, coalesce(pool_relevant, 0)::BIGINT AS pool_relevant, round(relevant / nullif(pool_relevant, 0), 9) AS pool_recall, round(1.0::DOUBLE / fr, 9) AS reciprocal_rank,
  context_missing::BIGINT AS context_missing, context_truncated::BIGINT AS context_truncated FROM mj LEFT JOIN pr USING (scenario_id)"""

_ROUNDED = ("precision_judged", "precision_returned", "judgement_coverage", "precision_slots", "pool_recall", "reciprocal_rank")


def _scenario_metrics(spark, sf_dir, split=None):
    run, pool, given = _judged(spark, sf_dir)
    return metrics.scenario_metrics(run, metrics.judgements(given, pool), pool, split)


@query(_JUDGED_SQL.replace("{where}", "") + _METRICS_SQL)
def run_metrics(spark, sf_dir):
    m = _scenario_metrics(spark, sf_dir)
    return m.withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query(_JUDGED_SQL.replace("{where}", "WHERE (rj.n % 2 = 0 AND rj.scenario_id = 's-0') OR rj.n % 3 = 0") + _METRICS_SQL)
def run_metrics_split(spark, sf_dir):
    """Metrics of the tasks of a split, which holds some tasks and some candidates in all scenarios."""
    r = _runs(spark, sf_dir).withColumn("n", F.substring("candidate_id", 5, 20).cast("bigint"))
    split = r.where("n % 2 = 0 AND scenario_id = 's-0'").select("candidate_id", "scenario_id").unionByName(r.where("n % 3 = 0").select("candidate_id", F.lit(None).cast("string").alias("scenario_id")))
    return _scenario_metrics(spark, sf_dir, split).withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query(_JUDGED_SQL.replace("{where}", "") + """SELECT count(*)::BIGINT AS scenarios, sum(returned)::BIGINT AS returned, sum(judged)::BIGINT AS judged, sum(relevant)::BIGINT AS relevant, sum(unjudged)::BIGINT AS unjudged, sum(outside_pool)::BIGINT AS outside_pool,
  sum(coalesce(pool_relevant, 0))::BIGINT AS pool_relevant, sum(context_missing)::BIGINT AS context_missing, sum(context_truncated)::BIGINT AS context_truncated FROM mj LEFT JOIN pr USING (scenario_id)""")
def metric_totals(spark, sf_dir):
    return metrics.totals(_scenario_metrics(spark, sf_dir))


@query(_JUDGED_SQL.replace("{where}", "") + "SELECT topic_fit, count(*)::BIGINT AS tasks, string_agg(DISTINCT 'v' || (lj.n % 2), ',' ORDER BY 'v' || (lj.n % 2)) AS evaluator_versions FROM lj JOIN pj USING (candidate_id, scenario_id) GROUP BY topic_fit")
def judgement_coverage(spark, sf_dir):
    _, pool, given = _judged(spark, sf_dir)
    return metrics.coverage(given, pool)


@query("""SELECT topic_fit, CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'pending' END AS review_status, count(*)::BIGINT AS n FROM jd GROUP BY 1, 2""")
def topic_report(spark, sf_dir):
    j = t.judgements(spark, sf_dir)
    even = F.substring("candidate_id", 5, 20).cast("bigint") % 2 == 0
    return state.topic_report(j.withColumn("review_status", F.when(even, "done").otherwise("pending")))


def _findings(spark, sf_dir):
    c = _cards(spark, sf_dir)
    j = t.judgements(spark, sf_dir).join(c.select("candidate_id"), "candidate_id", "left_semi")
    even = F.substring("candidate_id", 5, 20).cast("bigint") % 2 == 0
    return metrics.findings(j.withColumn("validation_status", F.when(even, "valid").otherwise("unknown")), c)


@query(_CARD_SQL + " SELECT candidate_id, candidate_id AS message_fullname, sha256(raw_body) AS text_digest FROM crd JOIN jd USING (candidate_id) WHERE doc_id % 2 = 0 AND topic_fit = 'yes'")
def findings(spark, sf_dir):
    return _findings(spark, sf_dir)[0].select("candidate_id", "message_fullname", sha_hex(F.col("text")).alias("text_digest"))


@query(_CARD_SQL + " SELECT CASE WHEN doc_id % 2 <> 0 THEN 'skipped_invalid' WHEN topic_fit <> 'yes' THEN 'skipped_uncertain' ELSE 'finding' END AS state, count(*)::BIGINT AS count FROM crd JOIN jd USING (candidate_id) GROUP BY 1")
def findings_counts(spark, sf_dir):
    return _findings(spark, sf_dir)[1]


# Audits -------------------------------------------------------------------------------------------------------------------------


def _archive(spark, sf_dir):
    """The archive holds the documents but every ninth, and every tenth twice; the corpus those of odd number, and every fifteenth twice."""
    d = t.document_messages(spark, sf_dir).withColumn("focus_text", F.col("raw_body")).withColumn("n", F.col("created_utc"))
    a = d.where("n % 9 <> 0").withColumn("source_id", F.col("subreddit")).withColumn("line", F.col("n"))
    a = a.unionByName(a.where("n % 10 = 0").withColumn("line", F.col("n") + 1_000_000_000))
    c = d.where("n % 2 = 1")
    c = c.unionByName(c.where("n % 15 = 0"))
    e = d.where("n % 4 <> 3").select(F.col("fullname").alias("exposure_id"), F.when(F.col("n") % 4 == 1, F.col("fullname")).alias("candidate_id"), F.when(F.col("n") % 4 == 0, F.col("fullname")).alias("message_fullname"), "source_revision_id", "thread_fullname", "focus_text")
    units_ = audit.identities(c.dropDuplicates(["fullname"]).withColumn("unit_id", F.col("fullname")), keep=("unit_id",))
    return audit.identities(a, keep=("source_id", "line")), audit.identities(c), e, units_


_AUDIT_SQL = """, ar AS (SELECT fullname, source_revision_id AS r, replace(lower(raw_body), 'ß', 'ss') AS text, subreddit AS source_id, doc_id AS n FROM dm WHERE doc_id % 9 <> 0 UNION ALL SELECT fullname, source_revision_id, replace(lower(raw_body), 'ß', 'ss'), subreddit, doc_id FROM dm WHERE doc_id % 9 <> 0 AND doc_id % 10 = 0),
co AS (SELECT fullname, doc_id AS n FROM dm WHERE doc_id % 2 = 1 UNION ALL SELECT fullname, doc_id FROM dm WHERE doc_id % 2 = 1 AND doc_id % 15 = 0),
ex AS (SELECT fullname AS exposure_id, doc_id AS n, CASE WHEN doc_id % 4 = 2 THEN 0 WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS m FROM dm WHERE doc_id % 4 <> 3)
"""


@query(_AUDIT_SQL + "SELECT exposure_id, CASE WHEN m = 0 THEN 'unresolved' ELSE 'matched' END AS status, m::BIGINT AS archive_matches FROM ex")
def archive_match(spark, sf_dir):
    a, _, e, u = _archive(spark, sf_dir)
    return audit.match_exposures(audit.resolve_exposures(e, u), a)


@query(_AUDIT_SQL + "SELECT source_id, count(*)::BIGINT AS records, count(*) FILTER (n % 2 = 1)::BIGINT AS matched_records FROM ar GROUP BY source_id")
def archive_coverage(spark, sf_dir):
    a, c, _, _ = _archive(spark, sf_dir)
    return audit.coverage(a, c)


_COLLISION_SQL = _AUDIT_SQL + ", x AS (SELECT fullname, count(*) AS a FROM ar GROUP BY 1), y AS (SELECT fullname, count(*) AS c FROM co GROUP BY 1)"


@query(_COLLISION_SQL + " SELECT fullname, coalesce(a, 0)::BIGINT AS archive_count, coalesce(c, 0)::BIGINT AS corpus_count FROM x FULL JOIN y USING (fullname) WHERE a > 1 OR c > 1")
def archive_collisions(spark, sf_dir):
    a, c, _, _ = _archive(spark, sf_dir)
    return audit.collisions(a, c).select("fullname", "archive_count", "corpus_count")


@query(_COLLISION_SQL + " SELECT fullname, a::BIGINT AS archive_count, coalesce(c, 0)::BIGINT AS corpus_count FROM x LEFT JOIN y USING (fullname) WHERE (a > 1 OR c > 1) AND fullname IN (SELECT exposure_id FROM ex WHERE n % 4 IN (0, 1))")
def partitioned_collisions(spark, sf_dir):
    """Only records that an exposure could match are looked at, and only identities of the archive are listed."""
    a, c, e, u = _archive(spark, sf_dir)
    return audit.collisions(audit.targeted(a, audit.resolve_exposures(e, u)), c, archive_only=True).select("fullname", "archive_count", "corpus_count")


@query(_AUDIT_SQL + "SELECT CASE WHEN m = 0 THEN 'unresolved' ELSE 'matched' END AS status, count(*)::BIGINT AS exposures, sum(m)::BIGINT AS archive_matches FROM ex GROUP BY 1")
def derived_coverage(spark, sf_dir):
    return audit.derived_coverage(archive_match(spark, sf_dir))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 'comment' WHEN doc_id % 3 = 1 THEN 'unknown' ELSE 'submission' END AS source_kind, doc_id % 3 = 2 AND doc_id % 2 = 0 AS corpus_present, count(*)::BIGINT AS n FROM dm GROUP BY 1, 2""")
def unresolved_diagnosis(spark, sf_dir):
    u = _document_units(spark, sf_dir)
    n = F.substring("unit_id", 5, 20).cast("bigint")
    rows = u.select(F.when(n % 3 == 0, F.concat(F.lit("t1_"), n.cast("string"))).when(n % 3 == 1, "x").otherwise(F.col("message_fullname")).alias("message_fullname"), "source_revision_id")
    return audit.unresolved_diagnosis(rows, u.where(n % 2 == 0), "s1")


# State --------------------------------------------------------------------------------------------------------------------------


@query("""SELECT fullname AS unit_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 4 <> 1 THEN 'blocked' WHEN doc_id % 4 = 0 THEN 'added' WHEN doc_id % 4 = 1 THEN 'removed' WHEN doc_id % 4 = 2 THEN 'changed' ELSE 'same' END AS state FROM dm""")
def snapshot_reconciliation(spark, sf_dir):
    u = _document_units(spark, sf_dir).withColumn("n", F.substring("unit_id", 5, 20).cast("bigint"))
    now = u.where("n % 4 <> 1").withColumn("content_hash", F.when(F.col("n") % 4 == 2, "new").otherwise(F.col("content_hash")))
    return state.reconcile(u.where("n % 4 <> 0"), now, u.where("n % 5 = 0"))


@query(""", was AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 3 <> 0), now AS (SELECT l_orderkey AS k, max(l_linestatus) AS h FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT CASE WHEN now.k IS NOT NULL AND now.k % 7 = 0 THEN 'blocked' WHEN was.k IS NULL THEN 'added' WHEN now.k IS NULL THEN 'removed' WHEN was.h IS DISTINCT FROM now.h THEN 'changed' ELSE 'same' END AS state, count(*)::BIGINT AS units, sum(coalesce(was.k, now.k))::BIGINT AS keys FROM was FULL JOIN now ON was.k = now.k GROUP BY 1""")
def reconciliation_at_scale(spark, sf_dir):
    """Reconciliation over larger tables: orders before, the orders of the lines now."""
    was = t.read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("content_hash"))
    now = t.read(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.max("l_linestatus").alias("content_hash"))
    return state.reconcile(was, now, now.where("unit_id % 7 = 0")).groupBy("state").agg(F.count("*").alias("units"), F.sum("unit_id").alias("keys"))


def _outbox(spark, sf_dir):
    """An outbox from the events, after one round: registered, a hundred claimed, completed; some claims are stale."""
    e = t.read(spark, sf_dir, "events")
    empty = spark.createDataFrame([], "identity string, scope string, records bigint, status string, observed bigint, deleted bigint, attempts bigint, claimed_at string, updated_at string, error string")
    rows = e.select(F.concat(F.lit("id-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("identity"), F.col("event_type").alias("scope"), F.col("user_id").cast("bigint").alias("records"))
    box = state.claim(state.register(empty, rows, "2024-01-01T00:00:00Z"), 100, "2024-01-02T00:00:00Z")
    n = F.substring("identity", 4, 12).cast("bigint")
    results = box.where("status = 'in_progress'").where(n % 3 != 0).select("identity", F.lit(5).cast("bigint").alias("observed"), F.lit(4).cast("bigint").alias("deleted"), F.when(n % 3 == 1, "broken").alias("error"))
    return state.complete(box, results, "2024-01-03T00:00:00Z")


_OUTBOX_SQL = """, ob AS (SELECT 'id-' || lpad(event_id::VARCHAR, 12, '0') AS identity, event_id AS n, row_number() OVER (ORDER BY event_id) <= 100 AS mine FROM events),
st AS (SELECT identity, CASE WHEN NOT mine THEN 'pending' WHEN n % 3 = 0 THEN 'in_progress' WHEN n % 3 = 1 THEN 'failed' ELSE 'applied' END AS status, mine FROM ob)
"""


@query(_OUTBOX_SQL + "SELECT s AS status, count(identity)::BIGINT AS n FROM (SELECT unnest(['pending', 'in_progress', 'applied', 'failed']) AS s) LEFT JOIN st ON st.status = s GROUP BY s")
def outbox_status(spark, sf_dir):
    return state.status_counts(_outbox(spark, sf_dir))


@query(_OUTBOX_SQL + "SELECT identity, status, CASE WHEN status = 'applied' THEN 4::BIGINT END AS deleted, NULL::VARCHAR AS problem FROM st")
def outbox_inventory(spark, sf_dir):
    return state.inventory(_outbox(spark, sf_dir)).select("identity", "status", "deleted", "problem")


@query(_OUTBOX_SQL + "SELECT CASE WHEN status = 'applied' THEN 'applied' ELSE 'pending' END AS status, count(*)::BIGINT AS n FROM st GROUP BY 1")
def outbox_recovery(spark, sf_dir):
    again = state.replay(state.recover_stale(_outbox(spark, sf_dir), "2024-01-02T12:00:00Z"), "2024-01-04T00:00:00Z")
    return again.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT count(*)::BIGINT AS messages, count(DISTINCT thread_fullname)::BIGINT AS threads, min(created_utc)::BIGINT AS first_utc, max(created_utc)::BIGINT AS last_utc, count(*)::BIGINT AS units, count(*) FILTER (turn <= 4)::BIGINT AS context_complete, count(*) FILTER (turn > 4)::BIGINT AS context_incomplete FROM cm""")
def operational_report(spark, sf_dir):
    m = t.conversation_messages(spark, sf_dir)
    return state.operational_report(m, units.search_units(m, context.ancestor_chains(m), "s1", max_words=1_000_000, overlap=0))


_LINES_SQL = """, ev AS (SELECT event_type AS source_id, event_id AS line_number, CASE WHEN event_id % 10 = 1 THEN 'not json' WHEN event_id % 10 = 2 THEN '[1, 2]' WHEN event_id % 10 = 3 THEN repeat('x', 300) ELSE props END AS raw_line, event_id % 10 AS k FROM events),
qa AS (SELECT *, CASE k WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'too_long' END AS problem FROM ev)
"""


def _lines(spark, sf_dir):
    e, k = t.read(spark, sf_dir, "events"), F.col("event_id") % 10
    raw = F.when(k == 1, "not json").when(k == 2, "[1, 2]").when(k == 3, F.repeat(F.lit("x"), 300)).otherwise(F.col("props"))
    return archive.quarantined(e.select(F.col("event_type").alias("source_id"), F.col("event_id").cast("bigint").alias("line_number"), raw.alias("raw_line")), 200)


@query(_LINES_SQL + "SELECT line_number::BIGINT AS line_number, problem FROM qa")
def json_quarantine(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_number", "problem")


@query(_LINES_SQL + "SELECT source_id, count(*)::BIGINT AS lines_seen, count(*) FILTER (problem IS NULL)::BIGINT AS valid, count(problem)::BIGINT AS invalid, min(line_number) FILTER (problem IS NOT NULL)::BIGINT AS first_invalid, sum(strlen(raw_line) + 1)::BIGINT AS bytes, count(problem) = 0 AS complete FROM qa GROUP BY source_id")
def reader_stats(spark, sf_dir):
    return archive.reader_stats(_lines(spark, sf_dir)).select("source_id", "lines_seen", "valid", "invalid", F.array_min("invalid_line_numbers").alias("first_invalid"), "bytes", "complete")


@query("""SELECT status, count(event_id)::BIGINT AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS status) LEFT JOIN events ON event_type = status GROUP BY 1""")
def job_status_counts(spark, sf_dir):
    return state.status_counts(t.read(spark, sf_dir, "events").select(F.col("event_type").alias("status")), statuses=("click", "error", "purchase", "refund", "signup", "view"))


@query("""SELECT sum(strlen('{"fullname":"' || fullname || '","subreddit":"' || subreddit || '"}') + 1)::BIGINT AS bytes FROM cm""")
def byte_estimate(spark, sf_dir):
    from ..functions.text import json_bytes

    return t.conversation_messages(spark, sf_dir).agg(json_bytes("fullname", "subreddit").alias("bytes"))


@query("""SELECT subreddit, count(*)::BIGINT AS rows, sha256(string_agg(fullname, chr(10) ORDER BY fullname)) AS digest FROM cm GROUP BY subreddit""")
def ordered_digests(spark, sf_dir):
    return t.conversation_messages(spark, sf_dir).groupBy("subreddit").agg(F.count("*").alias("rows"), ordered_digest(F.col("fullname"), F.col("fullname")).alias("digest"))


@query("""SELECT subreddit AS app_id, string_agg(fullname, ',' ORDER BY fullname) AS claim_ids FROM cm WHERE created_utc % 3 <> 0 OR created_utc % 5 = 0 GROUP BY 1""")
def claim_evidence(spark, sf_dir):
    n = F.col("created_utc")
    claims = t.conversation_messages(spark, sf_dir).select(F.col("subreddit").alias("app_id"), F.col("fullname").alias("claim_id"), (n % 3 == 0).alias("verified"), F.when(n % 5 != 0, "ref").alias("evidence_ref"))
    return state.missing_claim_evidence(claims)


@query("SELECT 'failed' AS status")
def source_status(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(F.when(F.col("event_id") == 5, "failed").when(F.col("event_id") % 7 == 0, "complete_with_errors").otherwise("complete").alias("status"))
    return state.source_status(rows)


@query("""SELECT unnest(['rows', 'years', 'owner']) AS "check", unnest(['ok', 'fail', 'missing']) AS status""")
def preflight(spark, sf_dir):
    facts = t.read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return state.preflight({"rows": F.col("n") > 0, "years": F.col("last") > F.lit("2030-01-01").cast("timestamp"), "owner": F.lit(None).cast("boolean")}, facts)
