"""Arithmetic in SQL functions against Python's own grammar."""

import ast
import math
import operator
import random

from pyspark.sql import functions as F

from lodestone.functions import arithmetic
from lodestone.functions.arithmetic import evaluate, evaluated

OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod}
FUNCTIONS = {"sqrt": lambda x: x**0.5, "abs": abs, "round": round, "min": min, "max": max, "sum": sum}


def plain(node):
    match node:
        case ast.Constant(value=v) if type(v) in (int, float):
            return float(v)
        case ast.BinOp(left=a, op=op, right=b):
            return OPERATORS[type(op)](plain(a), plain(b))
        case ast.UnaryOp(op=op, operand=a) if type(op) in (ast.USub, ast.UAdd):
            return -plain(a) if isinstance(op, ast.USub) else plain(a)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            own = [plain(a) for a in args]
            if name.lower() == "round" and len(own) == 2 and own[1] == int(own[1]):
                own[1] = int(own[1])
            return FUNCTIONS[name.lower()](*own)
        case ast.List(elts=elts):
            return [plain(e) for e in elts]
    raise ValueError(node)


def expected(text):
    try:
        x = plain(ast.parse(text.strip(), mode="eval").body)
        return None if isinstance(x, (complex, list)) or not math.isfinite(x) else float(x)
    except Exception:  # noqa: BLE001
        return None


def made(rng, depth):
    """A random expression."""
    if depth == 0 or rng.random() < 0.15:
        return rng.choice(["0", "1", "2", "3.5", ".25", "10", "7.", "1e2", "2E-1", "1_000", "0.1"])
    sub = lambda: made(rng, depth - 1)
    blank = rng.choice(["", " "])
    kind = rng.random()
    if kind < 0.6:
        return f"{sub()}{blank}{rng.choice(['+', '-', '*', '/', '%', '**'])}{blank}{sub()}"
    if kind < 0.72:
        return f"({sub()})"
    if kind < 0.84:
        return rng.choice("+-") + blank + sub()
    return rng.choice([f"sqrt({sub()})", f"abs( {sub()} )", f"ROUND({sub()})", f"round({sub()}, 2)", f"min({sub()}, {sub()})", f"max({sub()},{sub()},{sub()})", f"min([{sub()}, {sub()}])", f"sum([{sub()},{sub()}, {sub()}])", f"max ( [ {sub()} ] )"])


CASES = [
    "1+2*3", "-2**2", "2**-1", "2**3**2", "(1+2)*3", "-7 % 3", "7 % -3", "1/0", "5 % 0", "0**-1", "(-8)**0.5", "sqrt(-1)", "round(2.5)", "round(3.5)", "round(-2.5)", "round(2.675, 1)", "min(1)", "min()", "sum(1,2)", "sum([])", "max([])", "min([3])", "sum([1,2])+1",
    "1 2", "1,2", "", "   ", "+", "1+", "*1", "(1", "1)", "()", "sqrt", "sqrt 4", "sqrt(4)(5)", "2(3)", "abs(1,2)", "1//2", "a", "x+1", "1+sqrt(min(16,25))*2", "2*-3", "2--3", "2+-+-3", "1e400", "10**400", "1__0", "1.2.3", "$1", "[1]", "min([[1]])", "1 +\t2\n", "sum([min([1,2]),max([3,sum([4])])])", "1 and 2", "1 if 1 else 2", "'a'", "min#(1)", "|", "~-1", "(1,2)", "max((1),2)", "round(1.5, 0.5)", "sqrt(2,)", "9007199254740993", "-0.0",
]


#: A comma before the closing bracket isn't taken.
SKIPPED = {"sqrt(2,)"}


def test_against_python(spark):
    rng = random.Random(5)
    texts = CASES + [made(rng, 4) for _ in range(400)] + ["".join(rng.choices("12+-*/()% .,", k=rng.randint(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string").repartition(8)
    found = {r["i"]: r["v"] for r in rows.select("i", evaluate(F.col("t")).alias("v")).collect()}
    assert found[len(texts)] is None
    wrong = []
    for i, t in enumerate(texts):
        own = expected(t)
        same = own == found[i] or own is not None and found[i] is not None and math.isclose(own, found[i], rel_tol=1e-9, abs_tol=1e-9)
        if not same and t not in SKIPPED and "//" not in t:
            wrong.append((t, own, found[i]))
    assert not wrong, wrong[:20]
    assert sum(v is not None for v in found.values()) > 250


def test_no_python(spark):
    plan = spark.range(1).select(evaluate(F.lit("1").cast("string")).alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tables_equal_single_texts(spark, monkeypatch):
    """All forms compiled, then few of them, so that the others take the general way."""
    rng = random.Random(6)
    texts = CASES + [made(rng, 3) for _ in range(60)] + ["2min([3])", "1_0.5 + .5.5", "MAX([1, 2E3])", "x1", "sqrt4", "1. .5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string").repartition(8)
    single = {r["i"]: r["v"] for r in rows.select("i", evaluate(F.col("t")).alias("v")).collect()}
    for forms in (3, 200):
        monkeypatch.setattr(arithmetic, "FORMS", forms)
        assert {r["i"]: r["v"] for r in evaluated(rows, v=F.col("t")).collect()} == single
        assert evaluated(rows, v=F.col("t")).columns == ["i", "t", "v"]


def test_compiled_rows_need_no_parse(spark):
    """Rows of one form with many numbers: the time of the general way for as many would be minutes."""
    import time

    rows = spark.range(400_000).select(F.concat(F.col("id"), F.lit(" * (1 - 0.5) + -"), F.col("id"), F.lit("**2 - 7%3")).alias("t"))
    begin = time.monotonic()
    total = evaluated(rows, v=F.col("t")).agg(F.sum("v")).first()[0]
    assert math.isclose(total, sum(i * 0.5 - i**2 - 1 for i in range(400_000)), rel_tol=1e-9)
    assert time.monotonic() - begin < 30
