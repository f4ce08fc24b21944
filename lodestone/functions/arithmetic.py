"""Arithmetic in text columns, evaluated by SQL functions alone.

``evaluate`` cuts a text into tokens, puts them into postfix order by a fold with an operator stack, and folds the
result over a stack of numbers.  It knows + - * / % ** (which binds to the right, and more than a sign before it), signs,
parentheses, and sqrt, abs, round (one or two arguments; halves go to the even), min and max of several arguments or one
list, and sum of a list.  Numbers are doubles; % has the sign of its right side.  The value is null for null, for what
isn't such an expression, and where there is no real finite value.

``evaluated`` gives the same values for whole tables: texts that differ in their numbers alone have one form, the most frequent
forms are put into postfix order once, and their rows need plain arithmetic; the rows of all other forms go through ``evaluate``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+)?"
_TOKEN = rf"{_NUMBER}|\*\*|[-+*/%(),]|[a-z]+#?"
_PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "~+": 3, "~-": 3, "**": 4}
_FUNCTIONS = ["sqrt", "abs", "round", "min", "max", "min#", "max#", "sum#"]
#: Lists within lists are taken from the inside out, so many levels deep.
_LISTS = 4
#: Forms of texts, the most frequent ones, that ``evaluated`` puts into postfix order once.
FORMS = 32


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _head(array: Column) -> Column:
    return F.coalesce(F.get(array, F.lit(0)), F.lit(""))


def _after(array: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    # slice takes no more than there is
    return F.slice(array, n + 1, F.lit(1 << 20))


def _leading(array: Column, holds) -> Column:
    """How many elements from the first on hold."""
    return _let(F.array_position(F.transform(array, holds), False), lambda at: F.when(at == 0, F.size(array)).otherwise(at - 1).cast("int"))


def _rank(op: Column) -> Column:
    """How tightly an operator binds; 0 for what is none."""
    out = F.lit(0)
    for rank in sorted(set(_PRECEDENCE.values())):
        out = F.when(op.isin(*[o for o, n in _PRECEDENCE.items() if n == rank]), rank).otherwise(out)
    return out


def _state(out: Column, ops: Column, want: Column, ok: Column, last: Column) -> Column:
    return F.struct(out.alias("out"), ops.alias("ops"), F.coalesce(want, F.lit(False)).alias("want"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(last, F.lit("")).alias("last"))


def _closed(s: Column, token: Column) -> Column:
    """The state after a bracket that closes, or a comma: what stands above the open bracket goes out."""
    out, ops, want, ok = s["out"], s["ops"], s["want"], s["ok"]

    def found(inner: Column) -> Column:
        # the open bracket, and below it perhaps a function
        call = F.coalesce(F.get(ops, inner + 1), F.lit("")).isin(*_FUNCTIONS)
        closed, fits = F.concat(out, F.slice(ops, F.lit(1), inner)), F.size(ops) > inner
        ended = _state(F.when(call, F.concat(closed, F.slice(ops, inner + 2, F.lit(1)))).otherwise(closed), _after(ops, inner + F.when(call, 2).otherwise(1)), F.lit(False), ok & fits & (~want | ((s["last"] == "(") & call)), token)
        return F.when(token == ")", ended).otherwise(_state(closed, _after(ops, inner), F.lit(True), ok & ~want & fits & call, token))

    return _let(_leading(ops, lambda o: o != "("), found)


def _operator(s: Column, token: Column) -> Column:
    """The state after an operator: those before it that bind as tightly go out."""
    out, ops, want, ok = s["out"], s["ops"], s["want"], s["ok"]
    # ** binds to the right: equals stay
    least = _let(_rank(token), lambda r: r + (token == "**").cast("int"))
    above = _let(least, lambda n: _leading(ops, lambda o: _rank(o) >= n))
    return _let(above, lambda n: _state(F.concat(out, F.slice(ops, F.lit(1), n)), F.concat(F.array(token), _after(ops, n)), F.lit(True), ok & ~want, token))


def _ordered(s: Column, token: Column) -> Column:
    """The state after a token: postfix order so far, operators with the latest first, whether an operand is due."""
    out, ops, want, ok, last = s["out"], s["ops"], s["want"], s["ok"], s["last"]
    one, wrong = F.array(token), _state(out, ops, want, F.lit(False), token)
    return (
        F.when(~ok, s)
        .when(token == "(", _state(out, F.concat(one, ops), F.lit(True), want, token))
        # a function's name is followed by a bracket
        .when(last.isin(*_FUNCTIONS), wrong)
        .when(token.rlike(r"^[0-9.]"), _state(F.concat(out, one), ops, F.lit(False), want, token))
        .when(token.isin(")", ","), _closed(s, token))
        .when(want & token.isin("+", "-"), _state(out, F.concat(F.array(F.concat(F.lit("~"), token)), ops), F.lit(True), ok, token))
        .when(token.isin("+", "-", "*", "/", "%", "**"), _operator(s, token))
        .when(token.isin(*_FUNCTIONS), _state(F.concat(out, F.array(F.lit("|"))), F.concat(one, ops), F.lit(True), want, token))
        .otherwise(wrong)
    )


def _real(x: Column) -> Column:
    return _let(x, lambda v: F.when(F.abs(v) < float("inf"), v))


def _power(a: Column, b: Column) -> Column:
    return F.when((a != 0) | (b >= 0), F.pow(a, b))


def _called(name: Column, args: Column) -> Column:
    """args: from the last to the first."""
    n, a, b = F.size(args), F.get(args, F.lit(0)), F.get(args, F.lit(1))
    scale = F.pow(F.lit(10.0), a)
    return (
        F.when((name == "sqrt") & (n == 1) & (a >= 0), F.sqrt(a))
        .when((name == "abs") & (n == 1), F.abs(a))
        .when((name == "round") & (n == 1), F.rint(a))
        .when((name == "round") & (n == 2) & (a == F.floor(a)), _real(F.rint(b * scale) / scale))
        .when((name == "min") & (n > 1) | (name == "min#") & (n > 0), F.array_min(args))
        .when((name == "max") & (n > 1) | (name == "max#") & (n > 0), F.array_max(args))
        .when(name == "sum#", F.aggregate(args, F.lit(0.0), lambda x, y: x + y))
    )


def _pair(token: Column | str, a: Column, b: Column) -> Column:
    """What an operator makes of two numbers; a token that is known needs no choice."""
    remainder = _let(F.try_mod(a, b), lambda r: F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r))
    made = {"*": a * b, "+": a + b, "-": a - b, "/": F.try_divide(a, b), "%": remainder}
    if isinstance(token, str):
        return made.get(token, _power(a, b))
    return reduce(lambda out, op: F.when(token == op, made[op]).otherwise(out), reversed(made), _power(a, b))


def _number(token: Column) -> Column:
    return _real(F.regexp_replace(token, "_", "").try_cast("double"))


def _of_two(token: str, a: Column, b: Column) -> Column:
    # both are used more than once
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: _pair(token, p["a"], p["b"]))


def _called_with(name: Column, args: Column) -> Column:
    return _let(args, lambda own: F.when(~F.exists(own, lambda x: x.isNull()), _called(name, own)))


def _applied(stack: Column, token: Column) -> Column:
    """The numbers after a token of the postfix order, latest first; null is no value, and a mark where a call begins is NaN."""
    b, a = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
    top = lambda x, rest: F.concat(F.array(x.cast("double")), rest)

    def call(n: Column) -> Column:
        return top(_called_with(token, F.slice(stack, F.lit(1), n)), _after(stack, n + 1))

    return (
        F.when(token.rlike(r"^[0-9.]"), top(_number(token), stack))
        .when(token == "~-", top(-b, _after(stack, 1)))
        .when(token == "~+", top(b, _after(stack, 1)))
        .when(token == "|", top(F.lit(float("nan")), stack))
        .when(token.isin(*_FUNCTIONS), _let(_leading(stack, lambda x: ~F.coalesce(F.isnan(x), F.lit(False))), call))
        .otherwise(top(_real(_pair(token, a, b)), _after(stack, 2)))
    )


def _parse(text: Column, use) -> Column:
    """use(state after the last token), null for texts that can't be cut into tokens."""
    # a list as the only argument becomes a call of its own kind
    listed = reduce(lambda t, _: F.regexp_replace(t, r"\b(min|max|sum)\s*\(\s*\[([^\[\]]*)\]\s*\)", "$1#($2)"), range(_LISTS), F.lower(text))
    none = F.array().cast("array<string>")

    def parsed(plain: Column) -> Column:
        whole = lambda tokens: (F.array_join(tokens, "") == F.regexp_replace(plain, r"[ \t\r\n\f]+", "")) & ~text.contains("#")
        start = _state(none, none, F.lit(True), F.lit(True), F.lit(""))
        return _let(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), lambda tokens: F.when(whole(tokens), _let(F.aggregate(tokens, start, _ordered), use)))

    return _let(listed, parsed)


def _complete(s: Column) -> Column:
    return s["ok"] & ~s["want"] & ~F.exists(s["ops"], lambda o: (o == "(") | o.isin(*_FUNCTIONS))


def evaluate(text: Column) -> Column:
    """The value of an expression, as a double; null if it has none."""

    def value(s: Column) -> Column:
        return F.when(_complete(s), F.get(F.aggregate(F.concat(s["out"], s["ops"]), F.array().cast("array<double>"), _applied), F.lit(0)))

    return _real(_parse(text, value))


def _compiled(postfix: list[str], numbers: Column) -> Column:
    """The value of a form whose postfix order is known, from the numbers of a text, which keep their order there."""
    stack: list[Column | None] = []
    used = 0
    for token in postfix:
        if token == "0":
            stack.append(_number(F.get(numbers, F.lit(used))))
            used += 1
        elif token == "|":
            stack.append(None)
        elif token in ("~-", "~+"):
            x = stack.pop()
            stack.append(-x if token == "~-" else x)
        elif token in _FUNCTIONS:
            own = []
            while (x := stack.pop()) is not None:
                own.append(x.cast("double"))
            stack.append(_called_with(F.lit(token), F.array(*own) if own else F.array().cast("array<double>")))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(_real(_of_two(token, a, b)))
    return _real(stack[-1])


def evaluated(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with further columns: the value of each text, as ``evaluate`` gives it.

    A text's form is the text with 0 for each of its numbers. One job counts the forms; postfix orders of the ``FORMS`` most
    frequent ones come to the driver."""
    number = lambda name: F.lower(F.col(f"{name}_text"))
    wide = rows.withColumns({f"{name}_text": text for name, text in texts.items()})
    # a blank behind keeps neighbours apart
    wide = wide.withColumns({f"{name}_form": F.regexp_replace(number(name), _NUMBER, "0 ") for name in texts})
    forms = wide.select(F.explode(F.array(*[F.col(f"{name}_form") for name in texts])).alias("form")).where("form is not null")
    often = forms.groupBy("form").count().orderBy(F.desc("count"), "form").limit(FORMS)
    order = _parse(F.col("form"), lambda s: F.when(_complete(s), F.concat(s["out"], s["ops"])))
    known = [(r["form"], r["postfix"]) for r in often.select("form", order.alias("postfix")).collect()]
    wide = wide.withColumns({f"{name}_numbers": F.regexp_extract_all(number(name), F.lit(_NUMBER), F.lit(0)) for name in texts})

    def value(name: str) -> Column:
        out = evaluate(F.col(f"{name}_text"))
        for form, postfix in reversed(known):
            own = _compiled(postfix, F.col(f"{name}_numbers")) if postfix else F.lit(None).cast("double")
            out = F.when(F.col(f"{name}_form") == form, own).otherwise(out)
        return out

    return wide.withColumns({name: value(name) for name in texts}).select(*rows.columns, *texts)
