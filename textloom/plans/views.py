"""Message tables derived from the driver's tables, by SQL that both engines run, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.places import size_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: name -> (tables it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("orders",), """
SELECT o_orderkey AS msg_id, CAST(o_custkey AS STRING) AS sender, o_orderdate AS ts,
  CASE o_orderkey % 10
    WHEN 0 THEN 'Your verification code: ' || lpad(CAST(o_orderkey AS STRING), 6, '0')
    WHEN 1 THEN 'Payment received for order ' || CAST(o_orderkey AS STRING) || '. Thank you'
    WHEN 2 THEN 'Special offer: limited time deal, reply STOP to unsubscribe'
    WHEN 3 THEN 'Pay me back or I will keep calling you'
    WHEN 4 THEN 'Verify immediately: suspended account, click http://x.example/' || CAST(o_orderkey AS STRING)
    WHEN 5 THEN 'code 482913 verify immediately, click the link'
    WHEN 6 THEN 'See you at dinner'
    WHEN 7 THEN 'Pickup code: A' || lpad(CAST(o_custkey AS STRING), 5, '0')
    WHEN 8 THEN '  Flight   booking ' || CAST(o_orderkey AS STRING) || '  order   confirmed '
    ELSE 'Win now at bit.ly/' || CAST(o_orderkey AS STRING) END AS body
FROM orders"""),
    "labelled": (("messages", "orders"), """
SELECT CAST(m.msg_id AS STRING) AS id, m.msg_id, m.body AS text,
  CASE m.msg_id % 10 WHEN 2 THEN 'AD' WHEN 3 THEN 'HARASS' WHEN 4 THEN 'FRAUD' WHEN 5 THEN 'FRAUD' WHEN 9 THEN 'FRAUD' WHEN 6 THEN 'NEEDS_REVIEW' ELSE 'TRANSACTION' END AS label,
  CASE m.msg_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'hi' ELSE 'id' END AS language,
  o.o_orderstatus AS source, 'tpl-' || CAST(m.msg_id % 10 AS STRING) AS template_group, 'snd-' || CAST(o.o_custkey % 50 AS STRING) AS sender_group, o.o_custkey AS cust
FROM messages m JOIN orders o ON m.msg_id = o.o_orderkey"""),
    "predictions": (("labelled",), """
SELECT id, msg_id AS seq, CASE WHEN cust % 11 = 0 THEN 'AD' WHEN label = 'NEEDS_REVIEW' THEN 'AD' ELSE label END AS predicted FROM labelled WHERE cust % 13 <> 0"""),
    "corrections": (("labelled",), """
SELECT id, label AS old, CASE WHEN cust % 2 = 0 THEN 'AD' ELSE 'HARASS' END AS new, 'agent' AS reason, 'agent' AS source, 80 AS priority, msg_id AS seq FROM labelled WHERE msg_id % 3 = 0
UNION ALL SELECT id, label, CASE WHEN cust % 3 = 0 THEN 'FRAUD' WHEN cust % 3 = 1 THEN 'AD' ELSE 'SPAM' END, 'rules', 'rules', 100, msg_id FROM labelled WHERE msg_id % 5 = 0
UNION ALL SELECT id, label, 'TRANSACTION', 'rules again', 'rules', 100, msg_id + 1 FROM labelled WHERE msg_id % 35 = 0"""),
    "annotations": (("labelled",), """
SELECT id, CASE WHEN msg_id % 17 = 0 THEN '' ELSE text END AS text, language, source, label AS orig_label, label AS suggested_label, CASE WHEN msg_id % 7 = 0 THEN lower(label) ELSE label END AS label,
  CASE WHEN msg_id % 4 = 0 THEN '' ELSE 'ann-' || CAST(msg_id % 3 AS STRING) END AS annotator, CASE WHEN msg_id % 6 = 0 THEN '' ELSE template_group END AS template_group, CASE WHEN msg_id % 9 = 0 THEN 'seen' ELSE '' END AS notes
FROM labelled"""),
    "packs": (("labelled",), """
SELECT id, text, label AS orig_label, CASE WHEN cust % 7 = 0 THEN 'NEEDS_REVIEW' ELSE label END AS suggested_label, CASE WHEN cust % 5 = 0 THEN 'AD' ELSE label END AS label, language AS pack,
  CASE WHEN cust % 2 = 0 THEN 'ann-a' ELSE 'ann-b' END AS annotator, CASE WHEN cust % 9 = 0 THEN '[fix:AD->FRAUD] x' ELSE '' END AS notes, template_group FROM labelled"""),
    "splits": (("labelled",), """
SELECT id, text, label, template_group, sender_group, CASE WHEN cust % 10 < 8 THEN 'train' WHEN cust % 10 = 8 THEN 'validation' ELSE 'test' END AS split, CASE WHEN msg_id % 12 = 0 THEN CAST(msg_id - 4 AS STRING) END AS parent_id FROM labelled
UNION ALL SELECT id, text, label, template_group, sender_group, 'test', NULL FROM labelled WHERE msg_id % 101 = 0"""),
    "store": (("labelled",), """
SELECT msg_id AS message_uri, 'k' || CAST(msg_id AS STRING) AS deliver_key, CASE label WHEN 'TRANSACTION' THEN 'INBOX' WHEN 'NEEDS_REVIEW' THEN 'REVIEW' ELSE 'SUSPECT' END AS action, msg_id * 1000 AS created_at FROM labelled WHERE msg_id % 4 <> 1"""),
}


#: Tables of many narrow rows, with the key by which they are joined.
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id"}
#: Bytes of a file for one task, some 100,000 rows of ``orders``.
PIECE = 2 << 20


def pieces(spark: SparkSession, path: str, size: int = PIECE) -> int:
    """How many tasks a table is dealt over: one for each ``size`` bytes of its files, no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-size_of(spark, path) // size))


def spread(frame: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """A table that comes in fewer pieces than ``n``, dealt over so many, by its key if it has one; others stay as they are.

    Rows dealt by their key meet in a join by it without another shuffle, and the number is a fixed one, so a task's rows
    don't become more as the table grows.
    """
    if frame.rdd.getNumPartitions() >= n:
        return frame
    return frame.repartition(n, key) if key else frame.repartition(n)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        path = f"{sf_dir}/{name}.parquet"
        key = KEYS.get(name)
        return spread(spark.read.parquet(path), pieces(spark, path) if key else spark.sparkContext.defaultParallelism, key)
    needs, sql = VIEWS[name]
    frames = {n: view(spark, sf_dir, n) for n in needs}
    for n in needs:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, with the named views and what they need as common table expressions before it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            if n in VIEWS:
                add(n)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in needed)
    return f"WITH {parts} {sql}" if parts else sql


def query(name: str, sql: str | None, *names: str) -> Callable[[Query], Query]:
    """Registers a query and the SQL that gives the same rows; ``names``: the views that the SQL reads."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            sql_ = sql.strip()
            if sql_.upper().startswith("WITH ") and names:
                ORACLE[name] = with_views("", *names).rstrip() + ", " + sql_[5:]
            else:
                ORACLE[name] = with_views(sql_, *names)
        return f

    return register
