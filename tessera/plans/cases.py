"""Case tables: from conversations, from customers, orders and suppliers, and the built-in adversarial set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.registry import table


def conversation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn asks, the turns before it are the memories; the turn just before it is the relevant one.

    Turns have no time; turn t stands for noon of July 1 + t % 28, 2026.
    """
    own = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").withColumn("qt", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(own))
    rows = c.withColumn("query", F.min(F.when(F.col("turn") == F.col("qt"), F.col("text"))).over(own)).where("turn < qt")
    pos = F.row_number().over(own.orderBy("turn", "text")) - 1
    return rows.select(F.col("conv_id").cast("string").alias("case_id"), pos.cast("long").alias("pos"), F.concat_ws(":", "conv_id", "turn").alias("memory_id"), "role", "text", F.format_string("2026-07-%02dT12:00:00+00:00", 1 + F.col("turn") % 28).alias("ts"), "query", (F.col("turn") == F.col("qt") - 1).alias("relevant"))


# The adversarial set's templates; $r relation, $e entity, $v value, $o another relation, $i number, $2 and $3 number of two and three digits.
RELATIONS = (("code", "QK-$3"), ("email", "desk$i@mail.test"), ("version", "V$2"), ("provider", "Supplier$i"), ("owner", "Person$i"), ("status", "ACTIVE"), ("time", "09:$2"), ("location", "Room C$2"), ("quantity", "4$2"), ("price", "7$2"))
ANSWERABLE = (
    ("r", "The current $r for $e updated to $v.", 0),
    ("echo", "What is the current $r for $e?", 28),
    ("agenda", "The current $r for $e remains on the agenda only.", 29),
    ("review", "Review of the current $r for $e is scheduled.", 30),
    ("wrongsubj", "The current $r for CLEANADV-X-$3 is DECOY-$i.", 31),
    ("stale", "The previous $r for $e was OLD-$i.", 27),
    ("noise1", "The current color for CLEANADV-N-$3 updated to amber.", 26),
    ("noise2", "The current budget for CLEANADV-N-$3 updated to 4$3.", 25),
)
CATEGORIES = {
    "agenda": ("The current $r for $e remains on the agenda only.",),
    "review": ("Review of the current $r for $e is scheduled.",),
    "question": ("Question about the current $r for $e remains open.",),
    "no_value": ("The record contains no recorded value for the current $r of $e.",),
    "wrong_subject": ("The current $r for CLEANADV-OTHER-$3 updated to DECOY-$i.",),
    "wrong_relation": ("The current $o for $e updated to DECOY-$i.",),
    "stale_only": ("The previous $r for $e was OLD-$i.", "The historical $r for $e was ARCHIVE-$i."),
    "negative": ("The current $r for $e is not DECOY-$i.",),
    "inference": ("The current $r for $e is probably GUESS-$i.",),
    "meta": ("We discussed the current $r for $e during planning.",),
}
NOISE = (("color", "blue"), ("budget", "5$3"), ("owner", "Alex"), ("status", "READY"), ("provider", "Northwind"), ("code", "ZX-999"))
#: Questions with an answer among their memories, and without.
N_ANSWERABLE, N_WITHOUT = 80, 40
_TEMPLATE = "kind string, of string, name string, template string, day int, relevant boolean"


def _templates() -> list[tuple]:
    """(kind, category or none for all, name, template, day or 0 for one by number, relevant) of all memories."""
    out = [("answerable", None, name, text, day, name == "r") for name, text, day in ANSWERABLE]
    out += [("noevidence", c, f"core{k}", text, 20 + k, False) for c, texts in CATEGORIES.items() for k, text in enumerate(texts)]
    return out + [("noevidence", None, f"n{k}", f"The current {a} for CLEANADV-O-$3 updated to {b}.", 32 - k, False) for k, (a, b) in enumerate(NOISE, 1)]


def _filled(questions: DataFrame) -> DataFrame:
    """(case_id, category, query, pos, memory_id, text, ts, relevant) of questions (id, kind, category, r, v, e): the templates of their kind, filled.

    A case's memories are ordered by the hash of their id.
    """
    x = questions.join(F.broadcast(questions.sparkSession.createDataFrame(_templates(), _TEMPLATE)), "kind").where("of is null or of = category")  # a fixed table of some 25 rows
    text = F.col("template")
    for mark, value in (("$v", "v"), ("$r", "r"), ("$e", "e"), ("$o", F.when(F.col("r") == "provider", "code").otherwise("provider")), ("$i", F.col("id").cast("string")), ("$2", F.format_string("%02d", F.col("id") % 60)), ("$3", F.format_string("%03d", "id"))):
        text = F.replace(text, F.lit(mark), F.col(value) if isinstance(value, str) else value)
    day = F.when(F.col("day") > 0, F.col("day").cast("long")).otherwise(10 + F.col("id") % 8)
    x = x.select(F.format_string("%s-%03d", "kind", "id").alias("case_id"), "category", F.format_string("What is the current %s for %s?", "r", "e").alias("query"), F.concat(F.substring("kind", 1, 1), F.col("id"), F.lit("-"), "name").alias("memory_id"), text.alias("text"), F.format_string("2026-07-%02dT12:00:00+00:00", day).alias("ts"), "relevant")
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy(F.sha2("memory_id", 256))) - 1
    return x.withColumn("pos", pos.cast("long")).select("case_id", "category", "query", "pos", "memory_id", "text", "ts", "relevant")


def _at(values, k) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)


def adversarial_cases(spark: SparkSession) -> DataFrame:
    """The built-in questions with one answering memory, and without: relations take turns, categories stand in runs."""
    one = spark.range(1, N_ANSWERABLE + 1).select("id", F.lit("answerable").alias("kind"), F.lit("adversarial_answerable").alias("category"))
    two = spark.range(1, N_WITHOUT + 1).select("id", F.lit("noevidence").alias("kind"), _at(list(CATEGORIES), F.floor((F.col("id") - 1) * len(CATEGORIES) / N_WITHOUT)).alias("category"))
    turn = (F.col("id") - 1) % len(RELATIONS)
    x = one.unionByName(two).withColumns({"r": _at([r for r, _ in RELATIONS], turn), "v": _at([v for _, v in RELATIONS], turn), "e": F.format_string("CLEANADV-%s-%03d", F.upper(F.substring("kind", 1, 1)), "id")})
    return _filled(x)


def customer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same templates filled from every customer: the name is the entity, the nation's number gives relation and category,
    the market segment the value, and a balance below zero leaves the question without evidence."""
    c = table(spark, sf_dir, "customer")
    answered = F.col("c_acctbal") >= 0
    x = c.select(
        F.col("c_custkey").alias("id"),
        F.when(answered, "answerable").otherwise("noevidence").alias("kind"),
        F.when(answered, "adversarial_answerable").otherwise(_at(list(CATEGORIES), F.col("c_nationkey") % len(CATEGORIES))).alias("category"),
        _at([r for r, _ in RELATIONS], F.col("c_nationkey") % len(RELATIONS)).alias("r"),
        F.concat_ws("-", "c_mktsegment", "c_custkey").alias("v"),
        F.translate("c_name", "#", "-").alias("e"),
    )
    return _filled(x)


def account_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about customers and suppliers, with memories made of their rows.

    A customer's status is told by each order: finished ones state an old value, open ones a current one (below 100,000 a
    negated one), pending ones an update (in January an agenda item); times are those of the order's year, so updates
    can meet. A supplier is asked for location and balance at once; a balance below zero is only known as an old one.
    """
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("CUST-"), "o_custkey")
    said = lambda start, middle: F.concat(F.lit(f"The {start} status for "), name, F.lit(f" {middle} "), "o_orderpriority", F.lit("."))
    state = F.col("o_orderstatus")
    text = F.when(state == "F", said("previous", "was")).when((state == "O") & (F.col("o_totalprice") < 100000), said("current", "is not")).when(state == "O", said("current", "is")).when(F.month("o_orderdate") == 1, F.concat(F.lit("The current status for "), name, F.lit(" remains on the agenda only."))).otherwise(said("current", "updated to"))
    orders = o.select(F.concat(F.lit("cust-"), "o_custkey").alias("case_id"), F.lit("orders").alias("category"), F.concat(F.lit("What is the current status for "), name, F.lit("?")).alias("query"), F.concat(F.lit("o"), "o_orderkey").alias("memory_id"), text.alias("text"), F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-01-01T12:00:00+00:00")).alias("ts"), (state != "F").alias("relevant"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("SUPP-"), "s_suppkey")
    amount = F.floor("s_acctbal").cast("long").cast("string")
    balance = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("The current balance for "), name, F.lit(" updated to "), amount, F.lit("."))).otherwise(F.concat(F.lit("The previous balance for "), name, F.lit(" was "), amount, F.lit(".")))
    place = F.concat(F.lit("The current location for "), name, F.lit(" is "), "n_name", F.lit("."))
    memory = lambda kind, text, day, relevant: F.struct(F.concat(F.lit("s"), "s_suppkey", F.lit(f"-{kind}")).alias("memory_id"), text.alias("text"), F.lit(f"2026-07-{day}T12:00:00+00:00").alias("ts"), relevant.alias("relevant"))
    told = F.array(memory("location", place, "01", F.lit(True)), memory("balance", balance, "02", F.col("s_acctbal") >= 0))
    suppliers = s.select(F.concat(F.lit("supp-"), "s_suppkey").alias("case_id"), F.lit("suppliers").alias("category"), F.concat(F.lit("What is the current location and balance for "), name, F.lit("?")).alias("query"), F.explode(told).alias("m")).select("case_id", "category", "query", "m.*")
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "memory_id")) - 1
    return orders.unionByName(suppliers).withColumn("pos", pos.cast("long")).select("case_id", "category", "query", "pos", "memory_id", "text", "ts", "relevant")


#: The same rows as account_cases, as a CTE named av.
ACCOUNT_SQL = """av_o AS (SELECT 'cust-' || o_custkey AS case_id, 'orders' AS category, 'What is the current status for CUST-' || o_custkey || '?' AS query, 'o' || o_orderkey AS memory_id,
  CASE WHEN o_orderstatus = 'F' THEN 'The previous status for CUST-' || o_custkey || ' was ' || o_orderpriority || '.' WHEN o_orderstatus = 'O' AND o_totalprice < 100000 THEN 'The current status for CUST-' || o_custkey || ' is not ' || o_orderpriority || '.'
    WHEN o_orderstatus = 'O' THEN 'The current status for CUST-' || o_custkey || ' is ' || o_orderpriority || '.' WHEN month(o_orderdate) = 1 THEN 'The current status for CUST-' || o_custkey || ' remains on the agenda only.'
    ELSE 'The current status for CUST-' || o_custkey || ' updated to ' || o_orderpriority || '.' END AS text, strftime(o_orderdate, '%Y') || '-01-01T12:00:00+00:00' AS ts, o_orderstatus <> 'F' AS relevant FROM orders),
av_s AS (SELECT 'supp-' || s_suppkey AS case_id, 'suppliers' AS category, 'What is the current location and balance for SUPP-' || s_suppkey || '?' AS query, s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
av AS (SELECT case_id, category, query, row_number() OVER (PARTITION BY case_id ORDER BY ts, memory_id) - 1 AS pos, memory_id, text, ts, relevant FROM (SELECT * FROM av_o
  UNION ALL SELECT case_id, category, query, 's' || s_suppkey || '-location', 'The current location for SUPP-' || s_suppkey || ' is ' || n_name || '.', '2026-07-01T12:00:00+00:00', true FROM av_s
  UNION ALL SELECT case_id, category, query, 's' || s_suppkey || '-balance', CASE WHEN s_acctbal >= 0 THEN 'The current balance for SUPP-' || s_suppkey || ' updated to ' ELSE 'The previous balance for SUPP-' || s_suppkey || ' was ' END || floor(s_acctbal)::BIGINT || '.', '2026-07-02T12:00:00+00:00', s_acctbal >= 0 FROM av_s))"""


def customer_sql() -> str:
    """The same rows as customer_cases, as a CTE named av."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(quoted, t)) + ")" for t in _templates())
    listed = lambda values: "[" + ", ".join(map(quoted, values)) + "]"
    text = "template"
    for mark, value in (("$v", "v"), ("$r", "r"), ("$e", "e"), ("$o", "CASE WHEN r = 'provider' THEN 'code' ELSE 'provider' END"), ("$i", "id::VARCHAR"), ("$2", "printf('%02d', id % 60)"), ("$3", "printf('%03d', id)")):
        text = f"replace({text}, '{mark}', {value})"
    return f"""adv_t(kind, of_category, name, template, day, relevant) AS (VALUES {rows}),
adv_q AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'answerable' ELSE 'noevidence' END AS kind, CASE WHEN c_acctbal >= 0 THEN 'adversarial_answerable' ELSE {listed(list(CATEGORIES))}[c_nationkey % {len(CATEGORIES)} + 1] END AS category,
  {listed([r for r, _ in RELATIONS])}[c_nationkey % {len(RELATIONS)} + 1] AS r, c_mktsegment || '-' || c_custkey AS v, replace(c_name, '#', '-') AS e FROM customer),
adv_m AS (SELECT printf('%s-%03d', kind, id) AS case_id, category, printf('What is the current %s for %s?', r, e) AS query, kind[1] || id || '-' || name AS memory_id, {text} AS text,
  printf('2026-07-%02dT12:00:00+00:00', CASE WHEN day > 0 THEN day ELSE 10 + id % 8 END) AS ts, relevant FROM adv_q JOIN adv_t USING (kind) WHERE of_category IS NULL OR of_category = category),
av AS (SELECT case_id, category, query, row_number() OVER (PARTITION BY case_id ORDER BY sha256(memory_id)) - 1 AS pos, memory_id, text, ts, relevant FROM adv_m)"""
