"""Traces of the kinds that plain products do not show, one for each order line, and SQL for what they say.

A line has a quantity q, a small price p and a percentage d; ``kind`` picks the form of the trace: percentages,
fractions, units and currency, glyphs, parentheses, chains, powers, every way to state an answer, and lines of several
sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attempts import text

KINDS = 12
#: The kinds whose texts tell the percentage.
DISCOUNTED = (0, 8, 9)


def lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The lines' numbers; ``dealt`` over as many parts as shuffles have: a file of one row group is one task, and what is read from texts costs far more than reading it."""
    q, p, d = F.col("l_quantity").cast("int"), (1 + F.col("l_partkey") % 97).cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), q.alias("q"), p.alias("p"), d.alias("d"))
    if dealt:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "line")
    return rows.withColumn("kind", ((7 * F.col("key") + F.col("line") + F.col("q")) % KINDS).cast("int"))


def hundredths(value: Column) -> Column:
    """A whole number of hundredths with two places."""
    return F.concat(F.expr("d * p div 100").cast("string"), F.lit("."), F.lpad((value % 100).cast("string"), 2, "0"))


def traces(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return spelt(lines(spark, sf_dir, dealt), "key", "line")


def spelt(numbers: DataFrame, *kept: str) -> DataFrame:
    """The texts that numbers (kind, q, p, d) make."""
    q, p, d = F.col("q"), F.col("p"), F.col("d")
    r, part = q * p, hundredths(d * p)
    trace = [
        text(d, "% * ", p, " = ", part, "\n#### ", part),
        text("Mix ", q, "/", p, " cups and ", p, " parts.\nThe answer is: $", q),
        text("$", p, "/hour * ", q, " hour = $", r, "\n\\boxed{", r, "}"),
        text(q, " × ", p, " ＝ ", r, "\nso ", r, " boxes"),
        text("(", q, " + ", p, ") * 2 - ", q, " = ", 2 * p + q, "\n#### ", 2 * p + q),
        text(q, " / 1 = ", q, "\n#### ", q),
        text(q, " * ", p, " = ", r + 1, "\n#### $1,", F.lpad(q.cast("string"), 3, "0")),
        text("½ of ", 2 * q, " is ", q, "\n", q, " - ", p, " = ", q - p, "\nThe answer is ", q - p),
        text(q, " + ", p, " + ", d, " = ", q + p + d, "\n#### ", q + p + d),
        text(d, "**2 + ", q, "//2 = ", d * d + F.expr("q div 2"), "\n#### ", d * d + F.expr("q div 2")),
        F.lit("No figures here.\nNone at all"),
        text("Buy ", q, " boxes. Each costs ", p, " coins! Pay ", r, "."),
    ]
    gold = {0: text("<<", d, "%*", p, "=", part, ">>"), 5: text("<<", q, "*1=", q, ">>"), 7: text("<<", q, "-", p, "=", q - p, ">>"), 8: text("<<", q, "+", p, "+", d, "=", q + p + d, ">>")}
    other = text("<<", q, "*", p, "=", r, ">>")
    chosen, solution = F.lit(None).cast("string"), other
    for kind, t in enumerate(trace):
        chosen = F.when(F.col("kind") == kind, t).otherwise(chosen)
        solution = F.when(F.col("kind") == kind, gold.get(kind, other)).otherwise(solution)
    question = text("Take ", q, " and ", p, ".")
    return numbers.select(*kept, "kind", "q", "p", "d", question.alias("question"), solution.alias("gold_solution"), r.cast("double").alias("gold_answer"), chosen.alias("trace"))


#: The same from the numbers: what each kind of trace says.
HARD = """
base as (select l_orderkey as key, l_linenumber as line, l_quantity::int as q, (1 + l_partkey % 97)::int as p, round(l_discount * 100)::int as d from lineitem),
hard as (select *, (7 * key + line + q) % 12 as kind, q * p as r, row_number() over () as row from base),
said as (select *,
  case kind when 0 then [d, d / 100.0::double, p, d * p / 100.0::double] when 1 then [q / p::double, q, p] when 2 then [p, q, r] when 3 then [q, p, r] when 4 then [q, p, 2, 2 * p + q] when 5 then [q, 1]
    when 6 then [q, p, r + 1, 1000 + q] when 7 then [0.5::double, 1, 2, 2 * q, q, p, q - p] when 8 then [q, p, d, q + p + d] when 9 then [d, 2, q, d * d + q // 2] when 10 then []::double[] else [q, p, r] end as vals,
  case kind when 0 then d * p / 100.0::double when 2 then r when 3 then r when 4 then 2 * p + q when 5 then q when 6 then r when 7 then q - p when 8 then q + p + d when 9 then d * d + q // 2 end as a,
  case kind when 0 then d * p / 100.0::double when 2 then r when 3 then r when 4 then 2 * p + q when 5 then q when 6 then r + 1 when 7 then q - p when 8 then q + p + d when 9 then d * d + q // 2 end as c,
  list_sort(case kind when 0 then [d, p] when 2 then [q, p] when 3 then [q, p] when 4 then [q, p, 2, q] when 5 then [q, 1] when 6 then [q, p] when 7 then [q, p] when 8 then [q, p, d] when 9 then [d, 2, q, 2] end) as operands,
  case kind when 0 then ['*'] when 2 then ['*', '/'] when 3 then ['*'] when 4 then ['*', '+', '-'] when 5 then ['/'] when 6 then ['*'] when 7 then ['-'] when 8 then ['+'] when 9 then ['*', '+', '/'] end as ops,
  case kind when 0 then d * p / 100.0::double when 1 then q when 4 then 2 * p + q when 5 then q when 6 then 1000 + q when 7 then q - p when 8 then q + p + d when 9 then d * d + q // 2 when 10 then null else r end as answer,
  case kind when 0 then d * p / 100.0::double when 5 then q when 7 then q - p when 8 then q + p + d else r end as g_result,
  list_sort(case kind when 0 then [d, p] when 5 then [q, 1] when 7 then [q, -p] when 8 then [q, p, d] else [q, p] end) as g_operands,
  case kind when 7 then '-' when 8 then '+' else '*' end as g_op,
  case kind when 0 then [d || '% * ' || p || ' = ' || (d * p // 100) || '.' || lpad((d * p % 100)::varchar, 2, '0')] when 1 then ['Mix ' || q || '/' || p || ' cups and ' || p || ' parts.', 'The answer is: $' || q]
    when 2 then ['$' || p || '/hour * ' || q || ' hour = $' || r, '\\boxed{' || r || '}'] when 3 then [q || ' * ' || p || ' = ' || r, 'so ' || r || ' boxes'] when 4 then ['(' || q || ' + ' || p || ') * 2 - ' || q || ' = ' || (2 * p + q)]
    when 5 then [q || ' / 1 = ' || q] when 6 then [q || ' * ' || p || ' = ' || (r + 1)] when 7 then ['1/2 of ' || (2 * q) || ' is ' || q, q || ' - ' || p || ' = ' || (q - p), 'The answer is ' || (q - p)]
    when 8 then [q || ' + ' || p || ' + ' || d || ' = ' || (q + p + d)] when 9 then [d || '**2 + ' || q || '//2 = ' || (d * d + q // 2)] when 10 then ['No figures here.', 'None at all']
    else ['Buy ' || q || ' boxes.', 'Each costs ' || p || ' coins!', 'Pay ' || r || '.'] end as steps
  from hard)
"""


def said(select: str) -> str:
    return f"with {HARD} {select}"
