"""Tool-call validation over calls worded from the order table."""

from pyspark.sql import functions as F

from tidewright.functions import toolcalls
from tidewright.plans.registry import query

REASONS = ["not parsed", "malformed", "duplicate calls", "question names a tool", "unknown tool", "additional keys", "missing mandatory fields", "parameter validation", "unknown argument name", "argument value not in question"]


@query(
    "tool_call_checks",
    "SELECT o_orderkey, CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END AS reason, o_orderkey % 12 > 9 AS is_valid FROM orders",
)
def tool_call_checks(t):
    k = F.col("o_custkey").cast("string")
    good = F.concat(F.lit('{"name": "find_order", "arguments": {"customer": '), k, F.lit("}}"))
    one = lambda text: F.concat(F.lit("["), text, F.lit("]"))
    said = [
        F.lit("no json ["), good, F.concat(F.lit("["), good, F.lit(", "), good, F.lit("]")), one(good),
        one(F.lit('{"name": "other", "arguments": {}}')), one(F.concat(F.lit('{"extra": 1, "name": "find_order", "arguments": {"customer": '), k, F.lit("}}"))),
        one(F.lit('{"name": "find_order"}')), one(F.lit('{"name": "find_order", "arguments": {"customer": "x"}}')),
        one(F.concat(F.lit('{"name": "find_order", "arguments": {"customer": '), k, F.lit(', "colour": "red"}}'))), one(F.lit('{"name": "find_order", "arguments": {"customer": 987654321987}}')),
        one(good), one(good),
    ]
    case = F.col("o_orderkey") % 12
    answer = F.lit(None).cast("string")
    for i, text in enumerate(said):
        answer = F.when(case == i, text).otherwise(answer)
    ask = F.when(case == 3, F.concat(F.lit("Please call find_order for "), k)).otherwise(F.concat(F.lit("Show what customer "), k, F.lit(" bought")))
    tools = F.array(F.struct(F.lit("find_order").alias("name"), F.array(F.lit("customer")).alias("required"), F.create_map(F.lit("customer"), F.lit("integer")).alias("types")))
    rows = t.orders.select("o_orderkey", answer.alias("answer"), ask.alias("question"), tools.alias("tools"))
    return toolcalls.check_calls(rows).select("o_orderkey", "reason", "is_valid")
