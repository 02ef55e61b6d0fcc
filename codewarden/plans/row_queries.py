"""Registered queries: cleaning, joins, text and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.functions import encoding, numeric, text
from codewarden.operators import clean, lines, vocab
from codewarden.plans import views
from codewarden.plans.registry import query, rounded, round_doubles
from codewarden.plans.views import WORD, WS, sql

_WORDS = f"regexp_extract_all(text, '{WORD}')"
_NORMAL = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


def _joined(col, sep=" "):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


def _tokens(spark, sf):
    return views.code(spark, sf).withColumn("tokens", text.word_tokens(F.col("code")))


# --- projections and filters ----------------------------------------------------------------


@query("normalize_whitespace", f"SELECT doc_id AS idx, {_NORMAL} AS code FROM documents")
def normalize_whitespace(spark, sf):
    return clean.normalize_code(views.code(spark, sf))


@query("cast_target", "SELECT doc_id AS idx, toxic AS target FROM labels")
def cast_target(spark, sf):
    raw = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("idx"), F.col("toxic").cast("string").alias("target")
    )
    return clean.cast_target(raw)


@query(
    "truncate_or_drop",
    f"""SELECT doc_id AS idx, array_to_string(CASE WHEN len(w) >= 512 THEN list_slice(w, 1, 511)
          ELSE w END, ' ') AS tokens FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
)
def truncate_or_drop(spark, sf):
    cut = clean.truncate_or_drop(_tokens(spark, sf), 512)
    return cut.select("idx", F.array_join("tokens", " ").alias("tokens"))


@query(
    "truncate_or_drop_large",
    f"""SELECT doc_id AS idx, array_to_string(w, ' ') AS tokens
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) < 512""",
)
def truncate_or_drop_large(spark, sf):
    kept = clean.truncate_or_drop(_tokens(spark, sf), 512, ignore_large=True)
    return kept.select("idx", F.array_join("tokens", " ").alias("tokens"))


@query(
    "drop_empty",
    sql(
        f"""SELECT func_id, line_idx, code FROM (SELECT func_id, line_idx,
              trim(regexp_replace(line, '{WS}', ' ', 'g')) AS code FROM line_rows)
            WHERE length(code) > 0""",
        "line_rows",
    ),
)
def drop_empty(spark, sf):
    rows = views.line_rows(spark, sf).withColumnRenamed("line", "code")
    return clean.drop_empty(clean.normalize_code(rows)).select("func_id", "line_idx", "code")


@query(
    "exclude_by_flag",
    """SELECT d.doc_id AS idx, d.n_chars AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE NOT coalesce(l.toxic = 1, false)""",
)
def exclude_by_flag(spark, sf):
    flags = views.table(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("exclude_me")
    )
    docs = views.table(spark, sf, "documents").select("doc_id", "n_chars")
    return clean.exclude_by_flag(docs.join(flags, "doc_id", "left"), "exclude_me").select(
        F.col("doc_id").alias("idx"), F.col("n_chars").alias("n")
    )


def pair_records(spark, sf):
    """Documents as nested pair records: words on the vulnerable side, lines on the patched."""
    return views.documents(spark, sf).select(
        F.col("doc_id").alias("idx"),
        (F.col("doc_id") % 2).cast("int").alias("target"),
        F.struct(
            F.struct(text.word_tokens(F.col("text")).alias("tokens")).alias("vuln"),
            F.struct(text.code_lines(F.col("text")).alias("tokens")).alias("patch"),
        ).alias("pair"),
    )


PAIR_CODE = f"""SELECT doc_id AS idx, CAST(doc_id % 2 AS INTEGER) AS target,
    CASE WHEN doc_id % 2 = 1 THEN array_to_string({_WORDS}, ' ')
         ELSE array_to_string(string_split(text, chr(10)), ' ') END AS code FROM documents"""


def picked_code(pairs):
    return pairs.select(
        "idx", "target", text.pick_code_by_label(F.col("target"), F.col("pair")).alias("code")
    )


@query("pick_code_by_label", PAIR_CODE)
def pick_code_by_label(spark, sf):
    return picked_code(pair_records(spark, sf))


@query(
    "drop_p3",
    sql("SELECT idx, target, status FROM functions WHERE status <> 'NOT_VULNERABLE'", "functions"),
)
def drop_p3(spark, sf):
    return clean.drop_unchanged(views.functions(spark, sf)).select("idx", "target", "status")


@query("status_as_class", sql("SELECT idx, cwe, status, class FROM classed", "classed"))
def status_as_class(spark, sf):
    return clean.status_as_class(views.functions(spark, sf)).select(
        "idx", "cwe", "status", "class"
    )


@query(
    "yes_no_label",
    """SELECT l_orderkey * 8 + l_linenumber AS idx,
         CASE WHEN l_returnflag = 'R' THEN 'YES' ELSE 'NO' END AS plain,
         CASE WHEN l_returnflag = 'R' THEN ' YES' ELSE ' NO' END AS prefixed FROM lineitem""",
)
def yes_no_label(spark, sf):
    return views.scores(spark, sf).select(
        "idx",
        text.yes_no_label(F.col("label")).alias("plain"),
        text.yes_no_label(F.col("label"), " YES").alias("prefixed"),
    )


_PROMPT = f"'Question: ' || {_NORMAL} || chr(10) || chr(10) || 'Answer: '"


@query("make_prompt", f"SELECT doc_id AS idx, {_PROMPT} AS prompt FROM documents")
def make_prompt(spark, sf):
    return views.code(spark, sf).select("idx", text.make_prompt(F.col("code")).alias("prompt"))


@query(
    "fits_context",
    f"""SELECT doc_id AS idx, (len(regexp_extract_all(prompt || 'YES', '{WORD}')) < 400
          AND len(regexp_extract_all(prompt || 'NO', '{WORD}')) < 400) AS fits
        FROM (SELECT doc_id, {_PROMPT} AS prompt FROM documents)""",
)
def fits_context(spark, sf):
    prompts = views.code(spark, sf).withColumn("prompt", text.make_prompt(F.col("code")))
    return clean.fits_context(prompts, 400).select("idx", "fits")


@query(
    "skip_count",
    f"""SELECT CAST(count_if(n < 400) AS BIGINT) AS kept, CAST(count_if(n >= 400) AS BIGINT) AS skipped
        FROM (SELECT len(regexp_extract_all({_PROMPT} || 'YES', '{WORD}')) AS n FROM documents)""",
)
def skip_count(spark, sf):
    prompts = views.code(spark, sf).withColumn("prompt", text.make_prompt(F.col("code")))
    fits = F.col("fits")
    return clean.fits_context(prompts, 400).agg(
        F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped")
    )


@query("argmax_class", sql("SELECT idx, pred FROM class_preds", "class_preds"))
def argmax_class(spark, sf):
    return views.class_probs(spark, sf).select(
        "idx", numeric.argmax_class(F.col("probs")).alias("pred")
    )


def _slotted(spark, sf):
    """Orders as packs with padded labels and weights."""
    slots = F.sequence(F.lit(0), F.lit(7))
    used = (F.col("o_orderkey") % 7).cast("int") + 1
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pack"),
        F.transform(
            slots,
            lambda s: F.when(s < used, ((F.col("o_custkey") + s) % 2).cast("int")).otherwise(-100),
        ).alias("labels"),
        F.transform(
            slots,
            lambda s: F.when(s < used, ((F.col("o_custkey") + s) % 3).cast("double")).otherwise(
                -100.0
            ),
        ).alias("weights"),
    )


_SLOTS = """(SELECT o_orderkey AS pack, CAST(s AS INTEGER) AS slot,
    CASE WHEN s < o_orderkey % 7 + 1 THEN CAST((o_custkey + s) % 2 AS INTEGER) ELSE -100 END AS label,
    CASE WHEN s < o_orderkey % 7 + 1 THEN CAST((o_custkey + s) % 3 AS DOUBLE) ELSE -100.0 END AS weight
  FROM orders, generate_series(0, 7) AS g(s))"""


@query("valid_slots", f"SELECT pack, slot, label FROM {_SLOTS} WHERE label >= 0")
def valid_slots(spark, sf):
    return clean.valid_slots(_slotted(spark, sf)).select("pack", "slot", "label")


@query(
    "valid_slots_weighted",
    f"SELECT pack, slot, label, weight FROM {_SLOTS} WHERE label <> -100 AND weight > 0",
)
def valid_slots_weighted(spark, sf):
    return clean.valid_slots(_slotted(spark, sf), weights="weights").select(
        "pack", "slot", "label", "weight"
    )


@query(
    "status_weight",
    sql(
        "SELECT idx, status, CASE WHEN status = 'NOT_VULNERABLE' THEN 1.0::DOUBLE ELSE 30.0::DOUBLE END AS weight FROM logits",
        "logits",
    ),
)
def status_weight(spark, sf):
    return clean.status_weight(views.logits(spark, sf), 30.0).select("idx", "status", "weight")


@query(
    "weights_align",
    sql(
        """SELECT idx, target, CASE WHEN status = 'NOT_VULNERABLE' THEN 1.0::DOUBLE ELSE 30.0::DOUBLE END AS weight
           FROM functions""",
        "functions",
    ),
)
def weights_align(spark, sf):
    return clean.status_weight(views.functions(spark, sf), 30.0).select("idx", "target", "weight")


# --- joins ------------------------------------------------------------------------------------


@query("align_predictions", sql("SELECT idx, target, prob FROM predictions", "predictions"))
def align_predictions(spark, sf):
    functions = views.functions(spark, sf).select("idx", "target")
    preds = views.predictions(spark, sf).select("idx", "prob")
    return clean.align_predictions(functions, preds)


@query(
    "result_table",
    sql(
        """SELECT prob AS logits, target AS y_trues, prob > 0.5 AS y_preds, idx AS index,
             CAST(len(list_filter(string_split(code, chr(10)), lambda x: length(x) > 0)) AS INTEGER) AS num_lines,
             code FROM predictions WHERE split = 'test'""",
        "predictions",
    ),
)
def result_table(spark, sf):
    test = views.functions(spark, sf).filter("split = 'test'")
    preds = views.predictions(spark, sf).filter("split = 'test'").select("idx", "prob")
    return clean.result_table(test, preds)


def _flaw_texts(spark, sf):
    """Flaw lines of every document, as they are or, for some, altered."""
    rows = views.line_rows(spark, sf).filter("label = 1")
    altered = F.when(F.col("line_idx") % 2 == 1, F.concat("line", F.lit("#"))).otherwise(
        F.col("line")
    )
    return rows.select("func_id", altered.alias("line"))


_FLAWS = """(SELECT func_id, CASE WHEN line_idx % 2 = 1 THEN line || '#' ELSE line END AS line
  FROM line_rows WHERE label = 1)"""


@query(
    "flaw_line_match",
    sql(
        f"""SELECT func_id, line_idx, CAST(EXISTS (SELECT 1 FROM {_FLAWS} f
              WHERE f.func_id = r.func_id AND f.line = r.line) AS INTEGER) AS label FROM line_rows r""",
        "line_rows",
    ),
)
def flaw_line_match(spark, sf):
    rows = views.line_rows(spark, sf).select("func_id", "line_idx", "line")
    matched = lines.flaw_line_match(rows, _flaw_texts(spark, sf))
    return matched.select("func_id", "line_idx", "label")


@query(
    "flaw_snippet_contains",
    sql(
        f"""SELECT f.func_id, f.line, contains(d.text, f.line) AS verified
            FROM {_FLAWS} f JOIN documents d ON f.func_id = d.doc_id""",
        "line_rows",
    ),
)
def flaw_snippet_contains(spark, sf):
    docs = views.documents(spark, sf).select(F.col("doc_id").alias("func_id"), "text")
    return _flaw_texts(spark, sf).join(docs, "func_id").select(
        "func_id", "line", F.contains("text", "line").alias("verified")
    )


# --- text ---------------------------------------------------------------------------------------


@query(
    "count_lines",
    """SELECT doc_id AS idx, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0))
         AS INTEGER) AS num_lines FROM documents""",
)
def count_lines(spark, sf):
    return views.code(spark, sf).select("idx", text.count_lines(F.col("code")).alias("num_lines"))


def joined_flaws(spark, sf):
    """Each document's flaw lines joined by the separator, with extra marks at the ends."""
    flaws = F.transform(
        F.filter("lines", lambda x: x["label"] == 1), lambda x: F.concat(F.lit(" "), x["line"])
    )
    joined = F.concat(F.lit("/~"), F.array_join(flaws, "/~/"), F.lit("~/"))
    return views.line_arrays(spark, sf).select(
        "func_id", F.when(F.size(flaws) > 0, joined).alias("flaws")
    )


FLAW_TEXT = """(SELECT func_id, '/~' || string_agg(' ' || line, '/~/' ORDER BY line_idx) || '~/' AS flaws
  FROM line_rows WHERE label = 1 GROUP BY func_id)"""
_EDGES = f"^{WS}|{WS}$"


@query(
    "parse_flaw_lines",
    sql(
        f"""SELECT doc_id AS func_id, CAST(coalesce(len(parsed), 0) AS INTEGER) AS n,
              coalesce(array_to_string(parsed, '|'), '') AS parsed
            FROM documents LEFT JOIN (SELECT func_id, list_transform(
                string_split(regexp_replace(flaws, '^[/~]+|[/~]+$', '', 'g'), '/~/'),
                lambda x: regexp_replace(x, '{_EDGES}', '', 'g')) AS parsed FROM {FLAW_TEXT})
              ON doc_id = func_id""",
        "line_rows",
    ),
)
def parse_flaw_lines(spark, sf):
    parsed = text.parse_flaw_lines(F.col("flaws"))
    return joined_flaws(spark, sf).select(
        "func_id", F.size(parsed).alias("n"), F.array_join(parsed, "|").alias("parsed")
    )


@query(
    "strip_token_marks",
    """SELECT doc_id AS idx, array_to_string(string_split(
         replace(replace(replace(replace(text, ' ', 'Ġ '), chr(10), 'ĉ'), 'Ġ', ''), 'ĉ', 'Ċ'), 'Ċ'), '|')
         AS lines FROM documents""",
)
def strip_token_marks(spark, sf):
    marked = F.replace(F.replace("code", F.lit(" "), F.lit("Ġ ")), F.lit("\n"), F.lit("ĉ"))
    return views.code(spark, sf).select(
        "idx", F.array_join(text.marked_lines(F.array(marked)), "|").alias("lines")
    )


@query(
    "encode_flaw_line",
    sql(
        f"""SELECT func_id, line_idx, array_to_string(list_transform(list_filter(
              regexp_extract_all('@ ' || line, '{WORD}'), lambda t: t <> '@'),
              lambda t: replace(t, 'Ġ', '')), ' ') AS tokens FROM line_rows""",
        "line_rows",
    ),
)
def encode_flaw_line(spark, sf):
    return views.line_rows(spark, sf).select(
        "func_id",
        "line_idx",
        F.array_join(text.encode_flaw_line(F.col("line")), " ").alias("tokens"),
    )


@query(
    "escape_braces",
    """SELECT doc_id AS idx, replace(replace(replace(replace(text, 'e', '{{'), 'a', '}}'),
         '{{', '{ {'), '}}', '} }') AS code FROM documents""",
)
def escape_braces(spark, sf):
    braced = F.replace(F.replace("code", F.lit("e"), F.lit("{{")), F.lit("a"), F.lit("}}"))
    return views.code(spark, sf).select("idx", text.escape_braces(braced).alias("code"))


@query(
    "word_tokens",
    f"""SELECT doc_id AS idx, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ' ') AS tokens
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
)
def word_tokens(spark, sf):
    return _tokens(spark, sf).select(
        "idx", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens")
    )


@query(
    "corpus_lines",
    sql("SELECT line FROM line_rows WHERE length(line) > 0", "line_rows"),
)
def corpus_lines(spark, sf):
    return vocab.corpus_lines(views.code(spark, sf))


@query(
    "record_json",
    """SELECT o_orderkey AS idx, '{"idx":' || o_orderkey || ',"cwe":"' || o_orderpriority ||
         '","target":' || o_custkey % 2 || '}' AS line FROM orders""",
)
def record_json(spark, sf):
    record = F.struct(
        F.col("o_orderkey").alias("idx"),
        F.col("o_orderpriority").alias("cwe"),
        (F.col("o_custkey") % 2).cast("int").alias("target"),
    )
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idx"), F.to_json(record).alias("line")
    )


@query(
    "run_timestamp",
    """SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS folder,
         strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_base' AS suffixed FROM events""",
)
def run_timestamp(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id",
        text.run_folder(F.col("ts")).alias("folder"),
        text.run_folder(F.col("ts"), "base").alias("suffixed"),
    )


@query(
    "run_path",
    """SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') || '__' || event_type || '__test.txt' AS name
       FROM events""",
)
def run_path(spark, sf):
    archive = F.concat(F.lit("/data/in/"), "event_type", F.lit(".tar.gz"))
    return views.table(spark, sf, "events").select(
        "event_id", text.output_name(F.col("ts"), archive, F.lit("test.jsonl")).alias("name")
    )


# --- vocabulary and encoding ------------------------------------------------------------------

_VOCAB = f"""vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 4 AS INTEGER) AS id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS}) AS token FROM documents)
    GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 50252)
  UNION ALL SELECT * FROM (VALUES ('[UNK]', 0), ('[CLS]', 1), ('[SEP]', 2), ('[PAD]', 3), ('[MASK]', 4)))"""
_IDS = f"""ids AS (SELECT doc_id AS idx, list(coalesce(id, 0) ORDER BY i) AS ids FROM (
    SELECT doc_id, i, w[i] AS token FROM (
      SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (
        SELECT doc_id, {_WORDS} AS w FROM documents)))
  LEFT JOIN vocab USING (token) GROUP BY doc_id)"""


@query("train_vocab", f"WITH {_VOCAB} SELECT token, id FROM vocab")
def train_vocab(spark, sf):
    return vocab.train_vocab(views.code(spark, sf))


@query(
    "vocab_lookup",
    f"""WITH vocab AS (SELECT n_name AS token, CAST(n_nationkey + 5 AS INTEGER) AS id FROM nation)
        SELECT c_custkey AS idx, coalesce(v.id, 0) || ' ' || coalesce(w.id, 0) AS ids
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN vocab v ON n_name = v.token
        LEFT JOIN vocab w ON c_mktsegment = w.token""",
)
def vocab_lookup(spark, sf):
    nations = views.table(spark, sf, "nation").select("n_nationkey", "n_name")
    words = nations.select(
        F.col("n_name").alias("token"), (F.col("n_nationkey") + 5).cast("int").alias("id")
    )
    customers = views.table(spark, sf, "customer")
    texts = customers.join(
        nations, customers["c_nationkey"] == nations["n_nationkey"]
    ).select(F.col("c_custkey").alias("idx"), F.array("n_name", "c_mktsegment").alias("tokens"))
    return vocab.vocab_lookup(texts, words).select("idx", _joined("ids").alias("ids"))


@query(
    "encode_vocab",
    f"WITH {_VOCAB}, {_IDS} SELECT idx, array_to_string(ids, ' ') AS ids FROM ids",
)
def encode_vocab(spark, sf):
    return _encoded(spark, sf).select("idx", _joined("ids").alias("ids"))


def _encoded(spark, sf):
    docs = views.code(spark, sf)
    return vocab.encode_vocab(docs, vocab.train_vocab(docs))


_LENGTH_IDS = f"""(SELECT doc_id AS idx, list_transform({_WORDS}, lambda t: length(t) + 9) AS ids
  FROM documents)"""


def length_ids(spark, sf):
    """Documents as ids that need no vocabulary: word length + 9."""
    ids = F.transform(F.col("tokens"), lambda t: F.length(t) + 9)
    return _tokens(spark, sf).select("idx", ids.alias("ids"))


def _fixed(n: int, first: int, last: int, pad: int) -> str:
    body = f"list_concat(list_concat([{first}], list_slice(ids, 1, {n - 2})), [{last}])"
    return f"list_resize({body}, {n}, {pad})"


@query(
    "encode_fixed",
    f"SELECT idx, array_to_string({_fixed(400, 0, 2, 1)}, ' ') AS ids FROM {_LENGTH_IDS}",
)
def encode_fixed(spark, sf):
    ids = encoding.encode_fixed(F.col("ids"), 400, first=0, last=2, pad=1)
    return length_ids(spark, sf).select("idx", _joined(ids).alias("ids"))


@query(
    "encode_fixed_word",
    f"""WITH {_VOCAB}, {_IDS} SELECT idx, array_to_string({_fixed(512, 1, 2, 3)}, ' ') AS ids FROM ids""",
)
def encode_fixed_word(spark, sf):
    ids = encoding.encode_fixed(F.col("ids"), 512, first=1, last=2, pad=3)
    return _encoded(spark, sf).select("idx", _joined(ids).alias("ids"))


@query(
    "encode_single",
    f"""SELECT idx, array_to_string(list_resize(list_slice(ids, 1, 255), 256, 1), ' ') AS ids,
          CAST(least(len(ids), 255) AS INTEGER) AS used FROM {_LENGTH_IDS}""",
)
def encode_single(spark, sf):
    mask = encoding.single_mask(F.col("ids"), 256)
    return length_ids(spark, sf).select(
        "idx",
        _joined(encoding.encode_single(F.col("ids"), 256, pad=1)).alias("ids"),
        F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("used"),
    )


@query(
    "attention_mask",
    f"""SELECT idx, array_to_string(list_transform({_fixed(400, 0, 2, 1)},
          lambda x: CAST(x <> 1 AS INTEGER)), '') AS mask FROM {_LENGTH_IDS}""",
)
def attention_mask(spark, sf):
    fixed = length_ids(spark, sf).select(
        "idx", encoding.encode_fixed(F.col("ids"), 400, first=0, last=2, pad=1).alias("ids")
    )
    return fixed.select("idx", _joined(encoding.attention_mask(F.col("ids"), 1), "").alias("mask"))


@query(
    "reference_ids",
    sql(
        """SELECT idx, array_to_string(list_concat(list_concat([0],
             list_resize(CAST([] AS INTEGER[]), greatest(n - 2, 0), 1)), [2]), ' ') AS ids FROM lengths""",
        "lengths",
    ),
)
def reference_ids(spark, sf):
    ids = encoding.reference_ids(F.col("n"), first=0, ref=1, last=2)
    return views.lengths(spark, sf).select("idx", _joined(ids).alias("ids"))


@query(
    "preview",
    f"""SELECT doc_id AS idx, array_to_string({_WORDS}, '_') AS tokens FROM documents
        ORDER BY doc_id LIMIT 3""",
)
def preview(spark, sf):
    from codewarden.operators.sampling import preview as first_rows

    marked = _tokens(spark, sf).withColumn(
        "tokens",
        F.transform("tokens", lambda t, i: F.when(i > 0, F.concat(F.lit("Ġ"), t)).otherwise(t)),
    )
    return first_rows(marked).select("idx", F.array_join("tokens", "").alias("tokens"))


# --- probabilities ------------------------------------------------------------------------------


@query(
    "yes_probability",
    sql("SELECT idx, round(exp(z0) / (exp(z0) + exp(z1)), 6) AS p FROM logits", "logits"),
)
def yes_probability(spark, sf):
    z = F.col("logits")
    return views.logits(spark, sf).select(
        "idx", rounded(numeric.yes_probability(z[0], z[1])).alias("p")
    )


@query(
    "softmax",
    sql(
        """SELECT idx, round(exp(z0) / (exp(z0) + exp(z1)), 6) AS p0,
             round(exp(z1) / (exp(z0) + exp(z1)), 6) AS p1 FROM logits""",
        "logits",
    ),
)
def softmax(spark, sf):
    p = F.col("p")
    probs = views.logits(spark, sf).select("idx", numeric.softmax(F.col("logits")).alias("p"))
    return round_doubles(probs.select("idx", p[0].alias("p0"), p[1].alias("p1")))


@query("sigmoid", sql("SELECT idx, round(1 / (1 + exp(-z0)), 6) AS p FROM logits", "logits"))
def sigmoid(spark, sf):
    return views.logits(spark, sf).select(
        "idx", rounded(numeric.sigmoid(F.col("logits")[0])).alias("p")
    )
