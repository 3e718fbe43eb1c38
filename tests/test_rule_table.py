"""Rule tables by automaton against each expression by itself."""

import random

from pyspark.sql import functions as F

from textloom.operators.classify import RULES, Rule, match_rules
from textloom.operators.rule_table import RuleTable, fold, join_rule_table, literal_choices, match_rule_table, needed_literals
from textloom.plans.rule_queries import SPOKEN


def rule(k, pattern, priority=0):
    return Rule(f"R{k}", "en", "AD_HINT", priority, pattern, "AD", "SUSPECT", "r")


def test_literals_that_an_expression_needs():
    assert literal_choices(r"(?:verification\s+code|OTP)\s*[0-9]+") == [frozenset({"verification", "otp"})]
    assert literal_choices("a?b+(?:cd){2}[x-z]e") == [frozenset("b"), frozenset({"cd"}), frozenset("e")]
    assert literal_choices("(?:abc|[0-9])x*") == [] and literal_choices("(unclosed") == [] and literal_choices(r"\p{L}abc") == []
    assert literal_choices("ab(?=cd)") == [frozenset({"ab"})] and literal_choices("") == []
    assert needed_literals([r"order\s+1", r"order\s+77", "z"]) == [frozenset({"1"}), frozenset({"77"}), frozenset("z")]
    assert fold("İKıſ") == "ikis" and fold("OTP") == "otp"
    for r in RULES:
        assert needed_literals([r.pattern])[0], r.pattern


def test_the_fixed_rules_give_the_same_ids(spark):
    texts = [t for t, _ in SPOKEN] + ["", None, "OTP ſ 1234", "VERIFICATION   CODE 9911 提供给工作人员 转账", "x" * 50_000 + " BIT.LY/abc"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    table = RuleTable(spark, RULES)
    for row in rows.select("text", table.match(F.col("text")).alias("got"), match_rules(F.col("text")).alias("wanted")).collect():
        assert row.got == (row.wanted if row.text is not None else None)


def test_random_rules_equal_each_expression_by_itself(spark):
    rng = random.Random(9)
    pieces = ["win", "Prize", r"\s+", "[0-9]{2,3}", "(?:now|LATER)", "free?", "(?:a|[b-d])", "短信", r"\d", "ı", ".{0,5}", r"\.", "(?:x|)"]
    rules = [rule(k, "".join(rng.choices(pieces, k=rng.randrange(1, 5))), rng.randrange(5)) for k in range(300)]
    words = ["Win", "prize", "12", "345", "NOW", "later", "fre", "Free", "a", "c", "短信", "I", ".", "x", "  "]
    rows = spark.createDataFrame([("".join(rng.choices(words + [" "], k=rng.randrange(12))),) for _ in range(200)], "text string")
    for at_once in (7, 1000):
        got = rows.select("text", RuleTable(spark, rules, at_once).match(F.col("text")).alias("got"), match_rules(F.col("text"), tuple(rules)).alias("wanted")).collect()
        assert all(r.got == r.wanted for r in got) and sum(len(r.got) for r in got) > 1000


def test_long_tables_cost_what_a_text_holds(spark):
    rows = spark.createDataFrame([(f"Payment received for order {k}. Thank you",) for k in range(1000, 1200)] + [("See you at dinner",)], "text string")
    for n in (50, 2000):
        table = RuleTable(spark, [rule(k, rf"order\s+{k}\b") for k in range(1000, 1000 + n)])
        assert rows.agg(F.max(table.tried(F.col("text")))).first()[0] == 1
        assert rows.select(F.size(table.match(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == min(n, 200)
    assert [r.rule_ids for r in match_rule_table(rows.limit(1), [], "text").collect()] == [[]]


def test_rules_that_need_no_literal_always_run(spark):
    rows = spark.createDataFrame([("77",), ("abc",)], "text string")
    table = RuleTable(spark, [rule(1, "[0-9]+"), rule(2, "[a-z]+", 5)])
    assert [r[0] for r in rows.select(table.match(F.col("text"))).collect()] == [["R1"], ["R2"]]


def test_a_table_of_rules_joined_equals_each_expression_by_itself(spark):
    rng = random.Random(9)
    pieces = ["win", "Prize", r"\s+", "[0-9]{2,3}", "(?:now|LATER)", "free?", "(?:a|[b-d])", "短信", r"\d", "ı", ".{0,5}", r"\.", "(?:x|)"]
    rules = [rule(k, "".join(rng.choices(pieces, k=rng.randrange(1, 5))), rng.randrange(5)) for k in range(300)]
    words = ["Win", "prize", "12", "345", "NOW", "later", "fre", "Free", "a", "c", "短信", "I", ".", "x", "  "]
    rows = spark.createDataFrame([(k, "".join(rng.choices(words + [" "], k=rng.randrange(12)))) for k in range(200)] + [(200, None)], "k long, text string")
    table = spark.createDataFrame([(r.id, r.pattern, r.priority, k) for k, r in enumerate(rules)], "id string, pattern string, priority int, seq int")
    wanted = {r.k: r.ids for r in rows.select("k", match_rules(F.col("text"), tuple(rules)).alias("ids")).collect()} | {200: None}
    assert {r.k: r.rule_ids for r in join_rule_table(rows, table, "text", "k").collect()} == wanted
    assert {len(r.rule_ids) for r in join_rule_table(rows.limit(3), table.limit(0), "text", "k").collect()} == {0}
