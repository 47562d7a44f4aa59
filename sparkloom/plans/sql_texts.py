"""SQL as data: scripts, mapper XML and Java sources analysed as DataFrame columns.

Texts are cut and searched by column expressions, one row a finding, so that a
corpus of any size is analysed where its rows are; only aggregates (counts,
fingerprints) shuffle. Nothing here builds syntax trees.

A text is first cut into spans: literals, quoted names, dollar-quoted bodies,
comments, and the code between them. All patterns are possessive and unrolled,
so that they need no stack: literals of any length pass. Block comments nest up
to ``NESTED`` deep; what isn't closed goes on to the end of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NESTED = 12


def _block_comment(depth: int) -> str:
    inside = r"[^/*]++|/(?!\*)|\*(?!/)"
    out = rf"/\*(?:{inside})*+\*/"
    for _ in range(depth):
        out = rf"/\*(?:{inside}|{out})*+\*/"
    return rf"(?:{out}|/\*[\s\S]*+)"


_NOT_IN_NAME = r"(?<![A-Za-z0-9_$])"
_STRING = r"'[^']*+(?:''[^']*+)*+(?:'|\z)"
_ESCAPED = rf"{_NOT_IN_NAME}[eE]'(?:[^'\\]++|\\[\s\S]|'')*+(?:'|\z)"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
_TICKED = r"`[^`]*+(?:`|\z)"
_DOLLAR_MARK = rf"{_NOT_IN_NAME}\$(?:[A-Za-z_][A-Za-z0-9_]*+)?+\$"
_DOLLAR = rf"(?<tag>{_DOLLAR_MARK})[\s\S]*?(?:\k<tag>|\z)"
_COMMENT = rf"(?:--[^\n]*+|{_block_comment(NESTED)})"
_KEPT = "|".join((_ESCAPED, _STRING, _QUOTED, _TICKED, _DOLLAR))
_CODE = r"(?:[^'\"`$/;eE\-]++|(?<=[A-Za-z0-9_$])[eE]|[eE](?!'))++"
_SPAN = rf"{_KEPT}|(?:{_COMMENT}|{_CODE}|(?!{_DOLLAR_MARK})[$/;\-])++|[\s\S]"
_STATEMENT = rf"(?:{_KEPT}|{_COMMENT}|{_CODE}|[$/\-])++"
_NUMBER = r"[0-9]++(?:\.[0-9]*+)?+(?:[eE][+-]?[0-9]++)?+|\.[0-9]++"
_TOKEN = rf"{_KEPT}|{_COMMENT}|[#$]\{{[^}}]*+\}}|\$[0-9]++|[A-Za-z_][A-Za-z0-9_$]*+|{_NUMBER}|<>|!=|<=|>=|\|\||::|:=|=>|[^\s]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _has(text: Column, *marks: str) -> Column:
    """One of ``marks`` is in the text: much cheaper than a pattern, so asked first."""
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def _starts(text: Column, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.startswith(m)
    return out


def _is_literal(span: Column) -> Column:
    return _starts(span, "'", "E'", "e'")


def _is_body(span: Column) -> Column:
    return span.startswith("$") & span.rlike(r"^\$(?:[A-Za-z_][A-Za-z0-9_]*+)?+\$")


def _is_name(span: Column) -> Column:
    return _starts(span, '"', "`")


def _spans(sql: Column, code: Callable[[Column], Column], literal: Callable[[Column], Column] = lambda s: s, name: Callable[[Column], Column] = lambda s: s, body: Callable[[Column], Column] = lambda s: s) -> Column:
    """The text again, its spans changed by kind; ``code`` gets comments too.
    Text without quotes and dollars is one span of code."""
    change = lambda s: F.when(_is_literal(s), literal(s)).when(_is_name(s), name(s)).when(_is_body(s), body(s)).otherwise(code(s))
    cut = lambda text: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_SPAN), F.lit(0)), change), "")
    return _let(sql, lambda text: F.when(_has(text, "'", '"', "`", "$"), cut(text)).otherwise(code(text)))


def _bare(code: Column) -> Column:
    """Without comments, single spaces."""
    bare = lambda c: F.when(_has(c, "--", "/*"), F.regexp_replace(c, _COMMENT, " ")).otherwise(c)
    spaced = lambda c: F.when(_has(c, "  ", "\t", "\n", "\x0B", "\f", "\r"), F.regexp_replace(c, r"\s++", " ")).otherwise(c)
    return _let(bare(code), spaced)


def without_comments(sql: Column) -> Column:
    """Comments become spaces; those inside literals, quoted names and bodies stay."""
    return _spans(sql, lambda s: F.regexp_replace(s, _COMMENT, " "))


def flat(sql: Column) -> Column:
    """No comments, single spaces, no space at the ends; literals as they are."""
    return F.trim(_spans(sql, _bare))


def masked(sql: Column) -> Column:
    """``flat`` in lower case, with nothing of literals, quoted names and bodies but what they begin with if that is a wildcard."""
    wild = lambda s: F.concat(F.lit("'"), F.regexp_extract(s, r"^[eE]?'([%_]?+)", 1), F.lit("x'"))
    return F.trim(_spans(sql, lambda s: F.lower(_bare(s)), wild, lambda s: F.lit('"x"'), lambda s: F.lit("'x'")))


_BEGINS_TRANSACTION = r"^begin(?: (?:work|transaction|isolation|read)\b.*+)?+$"
_ROUTINE = r"\b(?:function|procedure)\b[^;]*?\b(?:is|as)\b(?! ?')"
_DECLARES = r"^declare\b(?! [a-z_]\w*+ (?:\w++ )*?cursor\b)"
_PACKAGE = r"\bpackage\b[^;]*?\b(?:is|as)\b"
_OPENS = r"(?<!end )\b(?:case|loop)\b|(?:^|\b(?:begin|then|else|loop) )if\b"


def _joined_blocks(pieces: Column) -> Column:
    """Pieces between semicolons to statements: those of a BEGIN … END block, a
    routine or a package are one. A routine's own BEGIN and its END make one pair."""
    n = lambda m, pattern, *marks: F.when(_has(m, *marks), F.regexp_count(m, F.lit(pattern)).cast("int")).otherwise(0)

    def counted(piece: Column) -> Column:
        m = piece["m"]
        return F.struct(
            piece["t"].alias("t"),
            (m.startswith("begin") & m.rlike(_BEGINS_TRANSACTION)).alias("alone"),
            n(m, r"\bbegin\b", "begin").alias("begins"),
            (n(m, _ROUTINE, "function", "procedure") + n(m, _DECLARES, "declare")).alias("headers"),
            (n(m, _PACKAGE, "package") + n(m, _OPENS, "case", "loop", "if") - n(m, r"\bend\b", "end")).alias("opens"),
        )

    def step(acc: Column, piece: Column) -> Column:
        headers = piece["headers"]
        begins = F.when((acc["depth"] == 0) & piece["alone"], 0).otherwise(piece["begins"])
        own = F.least(begins, acc["waits"] + headers)
        depth = F.greatest(F.lit(0), acc["depth"] + headers + begins - own + piece["opens"])
        text = F.when(acc["open"] == "", piece["t"]).otherwise(F.concat(acc["open"], F.lit("; "), piece["t"]))
        closed = depth == 0
        return F.struct(
            F.when(closed & (text != ""), F.array_append(acc["done"], text)).otherwise(acc["done"]).alias("done"),
            F.when(closed, F.lit("")).otherwise(text).alias("open"),
            depth.alias("depth"),
            F.when(closed, 0).otherwise(acc["waits"] + headers - own).alias("waits"),
        )

    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("waits"))
    last = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
    # In two steps, so that each piece is masked and counted once.
    texts = F.transform(pieces, lambda p: F.struct(flat(p).alias("t"), masked(p).alias("m")))
    return F.aggregate(F.transform(texts, counted), none, step, last)


def statements(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per statement: columns of ``scripts``, nth, statement.

    Statements end at semicolons outside literals, quoted names, bodies and
    comments, and outside BEGIN … END blocks and routines; a line that is only
    a slash ends one too."""
    pieces = F.regexp_extract_all(F.col(sql), F.lit(_STATEMENT), F.lit(0))
    blocks = F.col(sql).rlike(r"(?i)\b(?:begin|declare|package|procedure|function)\b")
    found = F.when(blocks, _joined_blocks(pieces)).otherwise(F.transform(pieces, flat))
    bare = F.transform(found, lambda s: F.when(s.startswith("/") | s.contains(" /"), F.regexp_replace(F.regexp_replace(s, r"^/(?: |$)", ""), r" /$", "")).otherwise(s))
    kept = F.filter(bare, lambda s: s != "")
    return scripts.select(*scripts.columns, F.posexplode(kept).alias("nth", "statement")).withColumn("nth", F.col("nth") + 1)


def tokens(rows: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per token: columns of ``rows``, nth, token, kind."""
    out = rows.select(*rows.columns, F.posexplode(F.regexp_extract_all(F.col(sql), F.lit(_TOKEN), F.lit(0))).alias("nth", "token"))
    t = F.col("token")
    kind = (
        F.when(_starts(t, "--", "/*"), "comment")
        .when(_is_literal(t), "string")
        .when(_is_name(t), "quoted")
        .when(_is_body(t), "body")
        .when(t.rlike(r"^(?:[#$]\{|\$[0-9])"), "parameter")
        .when(t.rlike(r"^\.?[0-9]"), "number")
        .when(t.rlike("^[A-Za-z_]"), "word")
        .otherwise("operator")
    )
    return out.withColumn("nth", F.col("nth") + 1).withColumn("kind", kind)


def comments(rows: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per comment, those inside dollar-quoted bodies included: columns of ``rows``, nth, comment, inside_body."""
    found = F.regexp_extract_all(F.col(sql), F.lit(_TOKEN), F.lit(0))
    of = lambda text: F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: _starts(t, "--", "/*"))
    bare = lambda body: F.regexp_replace(body, r"^\$\w*+\$|\$\w*+\$$", "")
    each = F.flatten(F.transform(found, lambda t: F.when(_starts(t, "--", "/*"), F.array(F.struct(t.alias("c"), F.lit(False).alias("b")))).when(_is_body(t), F.transform(of(bare(t)), lambda c: F.struct(c.alias("c"), F.lit(True).alias("b")))).otherwise(F.array().cast("array<struct<c:string,b:boolean>>"))))
    out = rows.select(*rows.columns, F.posexplode(each).alias("nth", "__c"))
    return out.select(*rows.columns, (F.col("nth") + 1).alias("nth"), F.col("__c.c").alias("comment"), F.col("__c.b").alias("inside_body"))


#: First words of statements by category.
CATEGORIES = {
    "DML": ("INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "COPY"),
    "DDL": ("CREATE", "ALTER", "DROP", "TRUNCATE", "COMMENT"),
    "DCL": ("GRANT", "REVOKE"),
    "TCL": ("COMMIT", "ROLLBACK", "SAVEPOINT", "START", "BEGIN", "END", "RELEASE"),
    "EXPLAIN": ("EXPLAIN",),
    "SESSION": ("SET", "SHOW", "RESET"),
}


def category(sql: Column) -> Column:
    """Kind of statement by its first word; behind WITH, by the first word that isn't in parentheses."""
    return _let(masked(sql), lambda text: _let(F.struct(text.alias("t"), F.upper(F.regexp_extract(text, r"^\(*\s*([a-z]+)", 1)).alias("h")), lambda x: _category(x["t"], x["h"])))


def _category(text: Column, head: Column) -> Column:
    out = F.when((head == "BEGIN") & ~text.rlike(_BEGINS_TRANSACTION) | (head == "DECLARE") & text.rlike(r"\bbegin\b"), "PLSQL")
    out = out.when((head == "WITH") & text.rlike(r"\) (?:insert|update|delete|merge)\b"), "DML")
    out = out.when(head.isin("SELECT", "WITH", "VALUES", "TABLE"), "DQL")
    for name, words in CATEGORIES.items():
        out = out.when(head.isin(*words), name)
    return out.otherwise("OTHER")


def fingerprint_text(sql: Column) -> Column:
    """Lower case but for quoted names, one line, literals and numbers as ?, lists of them as (?)."""
    number = r"(?=[0-9.])(?<![A-Za-z0-9_$.])(?:[0-9]++(?:\.[0-9]*+)?+(?:[eE][+-]?[0-9]++)?+|\.[0-9]++)"
    plain = _spans(sql, lambda s: F.lower(F.regexp_replace(_bare(s), number, "?")), lambda s: F.lit("?"), body=lambda s: F.lit("?"))
    return F.trim(_let(plain, lambda p: F.when(_has(p, "(?", "( ?"), F.regexp_replace(p, r"\( ?\?(?: ?, ?\?)++ ?\)", "(?)")).otherwise(p)))


def fingerprints(rows: DataFrame, sql: str = "sql", place: str = "id") -> DataFrame:
    """fingerprint, normalised text, how often, and the least place it is at."""
    found = rows.select(fingerprint_text(F.col(sql)).alias("normalised"), F.col(place).alias("place"))
    return found.groupBy("normalised").agg(F.count("*").alias("n"), F.min("place").alias("first_place")).withColumn("fingerprint", F.sha2("normalised", 256))


class LintRule(NamedTuple):
    code: str
    level: str
    pattern: str  # on the masked statement
    without: str | None = None  # and not this
    marks: tuple[str, ...] = ()  # words parted by |; one of each of these is in every text that the rule finds


_WHERE = r"^(?:(?!\bwhere\b).)*+\bwhere\b.*"  # from the first one on
#: Checks that a statement's text decides; patterns over masked text.
LINT_RULES = [
    LintRule("select-star", "prohibition", r"\bselect (?:distinct )?\*", marks=("select *|select distinct *",)),
    LintRule("lock-table", "prohibition", r"^lock table\b", marks=("lock table",)),
    LintRule("drop-cascade", "prohibition", r"^drop\b.*\bcascade\b", marks=("cascade",)),
    LintRule("no-where", "prohibition", r"^(?:update|delete)\b", r"\bwhere\b", marks=("update|delete",)),
    LintRule("leading-wildcard", "prohibition", r"\bi?like '[%_]", marks=("like '%|like '_",)),
    LintRule("function-on-column", "performance", _WHERE + r"\b(?:upper|lower|substr|substring|to_char|to_date|trunc|nvl|date|abs|length)\s*\(\s*[a-z_][\w.]*[^)]*\)\s*(?:=|<|>|like|in\b|between\b)", marks=("where", "upper|lower|substr|to_char|to_date|trunc|nvl|date|abs|length")),
    LintRule("same-table-compare", "caution", _WHERE + r"\b([a-z_]\w*)\.[a-z_]\w* ?(?:=|<>|<=|>=|<|>) ?\1\.[a-z_]\w*", marks=("where", ".", "=|<|>")),
    LintRule("scalar-subquery", "performance", r"^select\b(?:(?!\bfrom\b).)*+", r"^select\b(?:(?!\bfrom\b|\( ?select\b).)*+(?:\bfrom\b|$)", marks=("(select|( select",)),
    LintRule("not-in-subquery", "performance", r"\bnot in ?\( ?select\b|<> ?all\b", marks=("not in|<>",)),
    LintRule("long-in-list", "performance", r"\bin ?\((?:[^(),]++,){500}", marks=("in(|in (",)),
    LintRule("current-time", "performance", r"\b(?:now ?\(|current_timestamp\b|sysdate\b|localtimestamp\b)", marks=("now|current_timestamp|sysdate|localtimestamp",)),
    LintRule("count-star", "performance", r"\bcount ?\( ?\*? ?\)", marks=("count",)),
    LintRule("function-for-case", "performance", _WHERE + r"\b(?:nvl|nvl2|decode|iif) ?\(", marks=("where", "nvl|decode|iif")),
    LintRule("distinct-used", "performance", r"\bselect distinct\b", marks=("select distinct",)),
    LintRule("equal-range", "performance", r"\bbetween ([0-9]+(?:\.[0-9]+)?) and \1(?![0-9.])", marks=("between",)),
    LintRule("update-from-no-where", "performance", r"^update\b.*\bfrom\b", r"\bwhere\b", marks=("update", "from")),
    LintRule("merge-used", "performance", r"^merge\b", marks=("merge",)),
    LintRule("insert-select-no-columns", "performance", r"^insert into [\w.]+ select\b", marks=("insert into", "select")),
    LintRule("insert-many-tables", "performance", r"^insert (?:all|first)\b", marks=("insert all|insert first",)),
    LintRule("explain-used", "performance", r"^explain\b", marks=("explain",)),
    LintRule("connect-by", "performance", r"\bconnect by\b", marks=("connect by",)),
    LintRule("order-by-ordinal", "suggestion", r"\border by [0-9]+", marks=("order by",)),
    LintRule("insert-without-columns", "caution", r"^insert into [\w.]+ (?:values|select)\b", marks=("insert into",)),
    LintRule("or-in-where", "performance", _WHERE + r"\bor\b", marks=("where", "or")),
    LintRule("union-not-all", "performance", r"\bunion\b(?! all)", marks=("union",)),
    LintRule("negative-comparison", "performance", r"<>(?! ?all\b)|!=", marks=("<>|!=",)),
    LintRule("join-without-on", "performance", r"(?<!natural )(?<!cross )\bjoin\b", r"\b(?:on|using|natural|cross)\b", marks=("join",)),
    LintRule("select-for-update", "caution", r"\bfor (?:update|share|no key update|key share)\b", r"\b(?:nowait|skip locked|wait [0-9]+)\b", marks=("for update|for share|for no key update|for key share",)),
    LintRule("unlogged-table", "caution", r"^create unlogged table\b", marks=("unlogged",)),
    LintRule("offset-used", "suggestion", r"\boffset [0-9:?$]", marks=("offset",)),
    LintRule("limit-without-order", "suggestion", r"\b(?:limit|fetch (?:first|next))\b", r"\border by\b", marks=("limit|fetch",)),
    LintRule("null-comparison", "prohibition", r"(?:=|<>|!=) ?null\b", marks=("null",)),
    LintRule("text-substitution", "prohibition", r"\$\{[^}]*+\}", marks=("${",)),
    LintRule("swallowed-exception", "caution", r"\bwhen others then\b", r"\braise\b(?! (?:debug|log|notice|info)\b)", marks=("others",)),
    LintRule("goto-used", "caution", r"\bgoto [a-z_]\w*", marks=("goto",)),
    LintRule("concatenated-execute", "caution", r"\bexecute(?: immediate)? [^;]*\|\|", marks=("execute",)),
    LintRule("insert-in-loop", "performance", r"^(?:(?!\bloop\b).)*+\bloop\b.*\binsert into\b.*\bend loop\b", marks=("loop", "insert into")),
    LintRule("autonomous-transaction", "caution", r"\bpragma autonomous_transaction\b", marks=("pragma",)),
    LintRule("commit-in-block", "caution", r"^(?:begin\b(?! (?:work|transaction))|declare\b|create\b.*\bbegin\b).*\b(?:commit|rollback)\b", marks=("begin|declare|create", "commit|rollback")),
]
#: Length of a statement from which it counts as complex, and columns in ORDER BY or GROUP BY as many.
LONG_STATEMENT, MANY_COLUMNS = 4096, 10


def _clause(text: Column, head: str) -> Column:
    """The comma-separated parts of a clause of the outermost query, up to the next one."""
    end = r"(?= (?:from|where|group by|having|order by|limit|offset|fetch|for|window|union|intersect|except|minus)\b|$)"
    part = F.regexp_extract(F.regexp_replace(text, r"\([^()]*+\)", "()"), rf"\b{head} (.*?){end}", 1)
    return F.filter(F.transform(F.split(part, ","), lambda x: F.trim(F.regexp_replace(x, r" (?:asc|desc)\b.*$| nulls (?:first|last)$", ""))), lambda x: x != "")


def _uncovered_order(text: Column, covered_by_groups: bool) -> Column:
    """ORDER BY has a column that is no target name, alias or position, nor (if these count) a GROUP BY column."""
    groups = _clause(text, "group by") if covered_by_groups else F.array().cast("array<string>")
    parts = F.struct(_clause(text, r"select(?: distinct)?").alias("targets"), _clause(text, "order by").alias("order"), groups.alias("groups"))
    bare = lambda o: F.regexp_extract(o, r"(\w+)$", 1)

    def holds(p: Column, names: Column) -> Column:
        position = lambda o: o.rlike("^[0-9]+$") & (o.try_cast("int") <= F.size(p["targets"]))
        covered = lambda o: F.array_contains(names, o) | F.array_contains(names, bare(o)) | F.coalesce(position(o), F.lit(False))
        return F.exists(p["order"], lambda o: ~covered(o)) & ~F.exists(p["targets"], lambda t: t.rlike(r"(?:^|\.)\*$"))

    def names(p: Column) -> Column:
        own = F.array_union(F.transform(p["targets"], bare), F.transform(p["targets"], lambda t: F.regexp_replace(t, r" (?:as )?\w+$", "")))
        return F.array_union(own, p["groups"])

    return _has(text, "order by") & _let(parts, lambda p: _let(names(p), lambda n: holds(p, n)))


def _many(text: Column, head: str) -> Column:
    """The clause has more than ``MANY_COLUMNS`` parts: asked only where there are as many commas."""
    return _has(text, head) & (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) >= MANY_COLUMNS) & (F.size(_clause(text, head)) > MANY_COLUMNS)


#: Checks that count or compare parts of a statement, by code and level.
COLUMN_RULES: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("many-sort-columns", "prohibition"): lambda t: _many(t, "order by") | _many(t, "group by"),
    ("order-by-not-distinct", "prohibition"): lambda t: t.startswith("select distinct") & t.rlike(r"^select distinct\b") & _uncovered_order(t, False),
    ("order-by-not-grouped", "prohibition"): lambda t: t.startswith("select") & _has(t, "group by") & t.rlike(r"^select\b.*\bgroup by\b") & _uncovered_order(t, True),
    ("deep-subqueries", "performance"): lambda t: _has(t, "(select", "( select") & (F.regexp_count(t, F.lit(r"\( ?select\b")) >= 3),
    ("many-update-tables", "performance"): lambda t: t.startswith("update ") & t.rlike(r"^update [\w.]+(?: (?:as )?(?!set\b)\w+)?,"),
    ("group-by-used", "performance"): lambda t: _has(t, "group by") & t.rlike(r"\bgroup by\b"),
    ("long-statement", "suggestion"): lambda t: F.length(t) > LONG_STATEMENT,
}


def lint(rows: DataFrame, sql: str = "sql", rules: list[LintRule] = LINT_RULES, column_rules: dict = COLUMN_RULES) -> DataFrame:
    """One row per finding: columns of ``rows``, code, level."""
    finding = lambda code, level: F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))
    # Kept apart, so that the text is masked once.
    once = rows.select(*rows.columns, F.explode(F.array(masked(F.col(sql)))).alias("__text"))
    text = F.col("__text")
    marked = lambda r: reduce(lambda out, m: out & _has(text, *m.split("|")), r.marks, F.lit(True))
    checks = [F.when(marked(r) & text.rlike(r.pattern) & (~text.rlike(r.without) if r.without else F.lit(True)), finding(r.code, r.level)) for r in rules]
    checks += [F.when(holds(text), finding(*name)) for name, holds in column_rules.items()]
    return once.select(*rows.columns, F.explode(F.array_compact(F.array(*checks))).alias("__f")).select(*rows.columns, "__f.code", "__f.level")


def lint_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level", "code").count().withColumnRenamed("count", "n")


_NAME = r"(?:\"[^\"]++\"|`[^`]++`|[a-z_][\w$]*+)(?:\.(?:\"[^\"]++\"|`[^`]++`|[a-z_][\w$]*+))*+"
#: Least and most numbers of arguments of functions (fixed values); None: no end.
ARITIES: dict[str, tuple[int, int | None]] = {
    "abs": (1, 1), "ceil": (1, 1), "floor": (1, 1), "sqrt": (1, 1), "exp": (1, 1), "ln": (1, 1), "sign": (1, 1), "mod": (2, 2), "power": (2, 2), "log": (1, 2), "round": (1, 2), "trunc": (1, 2), "greatest": (1, None), "least": (1, None),
    "upper": (1, 1), "lower": (1, 1), "initcap": (1, 1), "length": (1, 1), "substr": (2, 3), "substring": (2, 3), "replace": (2, 3), "translate": (3, 3), "instr": (2, 4), "lpad": (2, 3), "rpad": (2, 3), "ltrim": (1, 2), "rtrim": (1, 2), "concat": (1, None), "concat_ws": (2, None), "split_part": (3, 3), "repeat": (2, 2), "reverse": (1, 1),
    "regexp_replace": (2, 6), "regexp_substr": (2, 4), "regexp_like": (2, 3), "to_char": (1, 2), "to_date": (1, 2), "to_number": (1, 2), "add_months": (2, 2), "months_between": (2, 2), "last_day": (1, 1), "next_day": (2, 2),
    "nvl": (2, 2), "nvl2": (3, 3), "decode": (3, None), "coalesce": (1, None), "nullif": (2, 2), "bit_and": (1, 1), "bit_or": (1, 1), "now": (0, 0),
}
CALL_DEPTH = 8


def function_calls(rows: DataFrame, sql: str = "sql", depth: int = CALL_DEPTH) -> DataFrame:
    """One row per call of a named function: columns of ``rows``, function (the
    last part of its name), n_arguments. Calls are found from the inside out, ``depth`` deep."""
    call = r"\b(?<![.\w])((?:[a-z_]\w*+\.)*+[a-z_]\w*+) ?\(([^()]*+)\)|\(([^()]*+)\)"
    once = rows.select(*rows.columns, F.explode(F.array(masked(F.col(sql)))).alias("__t0"))
    for k in range(depth):
        left = F.col(f"__t{k}")
        once = once.withColumn(f"__t{k + 1}", F.when(_has(left, "("), F.regexp_replace(left, call, " x ")).otherwise(left))
    found = F.flatten(F.array(*(F.when(_has(F.col(f"__t{k}"), "("), F.regexp_extract_all(f"__t{k}", F.lit(call), F.lit(0))).otherwise(F.array().cast("array<string>")) for k in range(depth))))
    count = lambda inside: F.when(inside == "", 0).otherwise(F.length(inside) - F.length(F.replace(inside, F.lit(","), F.lit(""))) + 1)
    # Made where calls are cut, so that filters on them don't search the call again.
    each = lambda c: F.struct(F.regexp_extract(c, r"(\w+) ?\(", 1).alias("function"), _let(F.trim(F.regexp_extract(c, r"\((.*)\)$", 1)), count).alias("n_arguments"))
    named = once.select(*rows.columns, F.explode(F.transform(F.filter(found, lambda c: c.rlike("^[a-z_]")), each)).alias("__c")).select(*rows.columns, "__c.*")
    return named.where(~F.col("function").isin("in", "values", "and", "or", "on", "using", "as", "any", "all", "some", "exists", "over", "by", "set", "into", "where", "when", "then", "case", "not", "is", "select", "from", "join", "table"))


def arity_findings(rows: DataFrame, sql: str = "sql", arities: dict[str, tuple[int, int | None]] = ARITIES) -> DataFrame:
    """Calls with too few or too many arguments: columns of ``rows``, function,
    n_arguments, finding. Functions that aren't listed give none."""
    listed = F.create_map(*(x for name, (a, b) in arities.items() for x in (F.lit(name), F.struct(F.lit(a).alias("least"), F.lit(b).cast("int").alias("most")))))
    calls = function_calls(rows, sql).withColumn("__a", F.try_element_at(listed, F.col("function")))
    a, n = F.col("__a"), F.col("n_arguments")
    number = lambda text, x: F.concat(F.lit(text), x.cast("string"))
    told = F.when((a.most == 0) & (n > 0), F.lit("takes no arguments")).when((a.least == a.most) & (n != a.least), number("requires exactly ", a.least)).when(n < a.least, number("requires at least ", a.least)).when(n > a.most, number("takes at most ", a.most))
    return calls.withColumn("finding", told).where(F.col("finding").isNotNull()).drop("__a")


_COMMA = "\uE000"
_LISTED = rf"{_NAME}(?: (?:as )?{_NAME})?+ ?, ?"


def table_names(rows: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per table named behind FROM, JOIN, INTO, UPDATE, USING or TABLE,
    comma lists included, in lower case but for quoted names; names of WITH
    queries, functions and words of EXTRACT, TRIM and the like aren't tables."""
    once = rows.select(*rows.columns, F.explode(F.array(F.trim(_spans(F.col(sql), lambda s: F.lower(_bare(s)), lambda s: F.lit("'x'"), body=lambda s: F.lit("'x'"))))).alias("__t"))
    once = once.where(_has(F.col("__t"), "from", "join", "update", "using", "table", "into"))
    forms = ("extract", "substring", "trim", "overlay", "position")
    text = F.when(_has(F.col("__t"), *forms), F.regexp_replace("__t", r"\b(extract|substring|trim|overlay|position) ?\([^()]*+\)", "$1()")).otherwise(F.col("__t"))
    lists = F.regexp_extract_all(text, F.lit(rf"(?:(?<!distinct )\bfrom|\bjoin|\bupdate|\busing|\btable(?: if (?:not )?exists)?+)(?: only)? ((?:{_LISTED}){{0,200}}{_NAME})(?! ?\()|\b(?:into|table(?: if not exists)?+) ({_NAME})"), F.lit(0))
    found = F.flatten(F.transform(lists, lambda x: F.split(F.regexp_replace(x, r"^(?:from|join|update|using|into|table(?: if (?:not )?exists)?)(?: only)? ", ""), " ?, ?")))
    found = F.array_distinct(F.transform(found, lambda x: F.regexp_extract(x, rf"^({_NAME})", 1)))
    queries = F.when(_has(F.col("__t"), " as (", "materialized ("), F.regexp_extract_all(text, F.lit(rf"(?:\bwith(?: recursive)?|\)? ?,) ({_NAME})(?: ?\([^()]*+\))? as (?:(?:not )?materialized )?\("), F.lit(1))).otherwise(F.array().cast("array<string>"))
    words = F.lit(["select", "values", "set", "lateral", "unnest"])
    return once.select(*rows.columns, F.explode(F.array_except(F.array_except(found, queries), words)).alias("table_name"))


def parameters(rows: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per parameter outside literals and comments, with its style: hash, dollar, question or numbered."""
    bare = _spans(F.col(sql), lambda s: F.regexp_replace(s, _COMMENT, " "), lambda s: F.lit("''"), lambda s: F.lit('""'), lambda s: F.lit("''"))
    found = F.regexp_extract_all(bare, F.lit(r"(#\{[^}]*+\}|\$\{[^}]*+\}|\$[0-9]++|\?)"), F.lit(1))
    out = rows.select(*rows.columns, F.posexplode(found).alias("nth", "parameter"))
    p = F.col("parameter")
    return out.withColumn("nth", F.col("nth") + 1).withColumn("style", F.when(p.startswith("#"), "hash").when(p.startswith("${"), "dollar").when(p == "?", "question").otherwise("numbered"))


def hints(rows: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per hint of all /*+ … */ comments: name and arguments, in lower case."""
    comments = F.filter(F.regexp_extract_all(F.col(sql), F.lit(_TOKEN), F.lit(0)), lambda t: t.startswith("/*+"))
    found = F.flatten(F.transform(comments, lambda c: F.regexp_extract_all(F.lower(F.substring(c, F.lit(4), F.length(c) - 5)), F.lit(r"([a-z_]\w*+(?:\s*+\([^)]*+\))?+)"), F.lit(1))))
    out = rows.select(*rows.columns, F.explode(found).alias("__h"))
    return out.select(*rows.columns, F.regexp_extract("__h", r"^(\w+)", 1).alias("hint"), F.trim(F.regexp_extract("__h", r"\(([^)]*+)\)", 1)).alias("arguments"))


#: Pairs of hints that exclude each other, besides any hint and its no_ form.
EXCLUSIVE_HINTS = [("hashjoin", "nestloop"), ("hashjoin", "mergejoin"), ("nestloop", "mergejoin"), ("tablescan", "indexscan"), ("tablescan", "indexonlyscan"), ("use_cplan", "use_gplan")]


def hint_conflicts(rows: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per pair of hints of one text that exclude each other over the same arguments: columns of ``rows``, first_hint, second_hint."""
    found = hints(rows, sql).select(*rows.columns, F.struct("arguments", "hint").alias("h"))
    by = found.groupBy(*rows.columns).agg(F.collect_set("h").alias("hs"))
    pair = lambda a, b: F.struct(F.lit(a).alias("first_hint"), F.lit(b).alias("second_hint"))
    same = lambda a, b: F.exists("hs", lambda x: (x["hint"] == a) & F.exists("hs", lambda y: (y["hint"] == b) & (y["arguments"] == x["arguments"])))
    pairs = F.array_compact(F.array(*(F.when(same(a, b), pair(a, b)) for a, b in EXCLUSIVE_HINTS)))
    negated = F.transform(F.filter("hs", lambda x: F.exists("hs", lambda y: (y["hint"] == F.concat(F.lit("no_"), x["hint"])) & (y["arguments"] == x["arguments"]))), lambda x: F.struct(x["hint"].alias("first_hint"), F.concat(F.lit("no_"), x["hint"]).alias("second_hint")))
    return by.select(*rows.columns, F.explode(F.concat(pairs, negated)).alias("__p")).select(*rows.columns, "__p.*")


def jdbc_calls(sql: Column) -> Column:
    """{? = call f(…)} and {call p(…)} as CALL f(…)."""
    return F.regexp_replace(sql, r"(?i)\{\s*+(?:\?\s*+=\s*+)?+call\s++([^}]*?)\s*+\}", "CALL $1")


def table_columns(ddl: DataFrame, sql: str = "sql") -> DataFrame:
    """Schema from CREATE TABLE statements: table_name, place, column_name, type, in lower case.

    Constraints of the table aren't columns; of repeated definitions the last
    by place in ``ddl`` isn't told apart: all rows are returned."""
    # Commas of quoted names and in parentheses, as in numeric(10,2), don't part columns: they wait as characters for private use.
    text = F.trim(_spans(F.col(sql), lambda s: F.lower(_bare(s)), lambda s: F.lit("'x'"), lambda s: F.translate(s, ",", _COMMA)))
    head = rf"^create (?:(?:global |local )?(?:temporary |temp )|unlogged |external |foreign )?table (?:if not exists )?({_NAME}) ?\("
    others = [c for c in ddl.columns if c != sql]
    # Kept apart, so that the text is made once.
    made = ddl.select(*others, F.explode(F.array(text)).alias("__t")).where(F.col("__t").startswith("create ") & F.col("__t").rlike(head))
    text = F.col("__t")
    body = F.regexp_replace(text, head, "")
    held = F.regexp_replace(body, r"\(([^(),]*+), ?([^(),]*+)\)", f"($1{_COMMA}$2)")
    parts = F.filter(F.transform(F.split(F.regexp_replace(held, r"\)[^)]*+$", ""), ","), lambda x: F.trim(x)), lambda p: p.rlike(rf"^{_NAME} ") & ~p.rlike(r"^(?:constraint|primary|unique|foreign|check|like|exclude|key|index)\b"))
    made = made.select(*others, F.regexp_extract(text, head, 1).alias("table_name"), F.posexplode(parts).alias("place", "__c"))
    kind = F.regexp_extract("__c", rf"^{_NAME} ((?:double precision|character varying|bit varying|timestamp(?: ?\([^)]*\))? with(?:out)? time zone|\w+)(?: ?\([^)]*\))?(?:\[\])*)", 1)
    whole = lambda x: F.translate(x, _COMMA, ",")
    return made.select(*others, whole(F.col("table_name")).alias("table_name"), (F.col("place") + 1).alias("place"), whole(F.regexp_extract("__c", rf"^({_NAME})", 1)).alias("column_name"), whole(kind).alias("type"))


def routines(scripts: DataFrame, sql: str = "sql", place: str = "id") -> DataFrame:
    """One row per function or procedure named in a package or its body: package, in_body, kind, routine, n_parameters, place."""
    text = masked(F.col(sql))
    head = rf"\bcreate (?:or replace )?package (body )?({_NAME}) (?:is|as)\b"
    some = scripts.where(text.rlike(head)).select(F.col(place).alias("place"), text.alias("t"))
    some = some.select("place", F.regexp_extract("t", head, 2).alias("package"), (F.regexp_extract("t", head, 1) != "").alias("in_body"), F.explode(F.regexp_extract_all("t", F.lit(rf"\b(?:procedure|function) {_NAME}(?: ?\([^)]*+\))?"), F.lit(0))).alias("r"))
    inside = F.regexp_extract("r", r"\(([^)]*+)\)", 1)
    count = F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))
    return some.select("package", "in_body", F.regexp_extract("r", r"^(\w+)", 1).alias("kind"), F.regexp_extract("r", rf"^\w+ ({_NAME})", 1).alias("routine"), count.alias("n_parameters"), "place")


def package_mismatches(found: DataFrame) -> DataFrame:
    """Routines that a package's specification and body don't both have, with the same number of parameters:
    package, kind, routine, n_parameters, fault (missing in body, or private: only in the body)."""
    keys = ["package", "kind", "routine", "n_parameters"]
    sides = found.groupBy(*keys).agg(F.bool_or("in_body").alias("in_body"), F.bool_or(~F.col("in_body")).alias("in_spec"))
    return sides.where(~(F.col("in_body") & F.col("in_spec"))).select(*keys, F.when(F.col("in_spec"), "missing in body").otherwise("private").alias("fault"))


def transactions(found: DataFrame, script: str = "id", nth: str = "nth", sql: str = "statement") -> DataFrame:
    """Statements of scripts by transaction: script, transaction (from 1), first and last place, n (statements other than those that begin or end one) and how it ended: commit, rollback or open."""
    head = F.regexp_extract(masked(F.col(sql)), r"^(\w+(?: transaction)?)", 1)
    ends = F.when(head.isin("commit", "end"), "commit").when(head.isin("rollback", "abort") & ~masked(F.col(sql)).rlike(r"^rollback(?: work| transaction)? to\b"), "rollback")
    by = W.partitionBy(script).orderBy(nth).rowsBetween(W.unboundedPreceding, -1)
    rows = found.select(script, nth, ends.alias("ends"), head.isin("begin", "begin transaction", "start transaction").alias("begins"))
    rows = rows.withColumn("transaction", (F.count("ends").over(by) + 1).cast("int"))
    out = rows.groupBy(script, "transaction").agg(F.min(nth).alias("first_place"), F.max(nth).alias("last_place"), F.count_if(F.col("ends").isNull() & ~F.col("begins")).cast("int").alias("n"), F.coalesce(F.max("ends"), F.lit("open")).alias("ended"))
    return out.where((F.col("n") > 0) | (F.col("ended") != "open"))


_XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def mapper_statements(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per select, insert, update or delete of a mapper XML: kind, statement id, SQL on one line.

    Tags inside a statement are dropped and their text kept; ``include`` of a
    fragment of the same file is replaced by its text, two deep."""
    bare = F.regexp_replace(F.col(content), r"<!--[\s\S]*?-->", " ")
    attribute = lambda tag, name: F.coalesce(F.nullif(F.regexp_extract(tag, rf"\b{name}\s*+=\s*+\"([^\"]*+)\"", 1), F.lit("")), F.regexp_extract(tag, rf"\b{name}\s*+=\s*+'([^']*+)'", 1))
    fragments = F.regexp_extract_all(bare, F.lit(r"<sql\b[^>]*+>[\s\S]*?</sql\s*+>"), F.lit(0))
    found = F.regexp_extract_all(bare, F.lit(r"<(select|insert|update|delete)\b[^>]*+>[\s\S]*?</\1\s*+>"), F.lit(0))
    out = files.select(*files.columns, fragments.alias("__fragments"), F.explode(found).alias("__s"))
    inner = lambda x: F.regexp_replace(x, r"^<[^>]*+>|</[a-z]++\s*+>$", "")
    include = lambda text: F.regexp_replace(text, r"<include\s++refid\s*+=\s*+[\"']([^\"']*+)[\"']\s*+(?:/>|>\s*+</include\s*+>)", "<include $1/>")
    filled = lambda text: F.aggregate("__fragments", include(text), lambda acc, f: F.replace(acc, F.concat(F.lit("<include "), attribute(f, "id"), F.lit("/>")), include(inner(f))))
    tag = F.regexp_extract("__s", r"^<[^>]*+>", 0)
    body = F.regexp_replace(F.regexp_replace(filled(filled(inner(F.col("__s")))), r"<!\[CDATA\[|\]\]>", ""), r"</?+[a-zA-Z][^>]*+>", " ")
    for entity, char in _XML_ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(char))
    return out.select(*files.columns, F.regexp_extract("__s", r"^<(\w+)", 1).alias("kind"), attribute(tag, "id").alias("statement_id"), F.trim(F.regexp_replace(body, r"\s++", " ")).alias("sql"))


_JAVA = r'"""[\s\S]*?"""|"(?:[^"\\\n]++|\\.)*+"|' + r"'(?:[^'\\\n]++|\\.)*+'|//[^\n]*+|/\*[\s\S]*?\*/|[A-Za-z_$][\w$]*+|[^\s]"


def java_statements(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per string of a Java source that begins like SQL: nth, sql.

    Literals joined by + count as one, text blocks too; comments are skipped
    and escapes resolved."""
    tokens = F.filter(F.regexp_extract_all(F.col(content), F.lit(_JAVA), F.lit(0)), lambda t: ~_starts(t, "//", "/*"))
    plain = F.transform(tokens, lambda t: F.when(t.startswith('"""'), F.concat(F.lit('"'), F.replace(F.regexp_replace(F.regexp_replace(t, r'^"""|"""$', ""), r"\s++", " "), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(t))
    # A line a token: no literal has a line feed, so that + between two literals is seen.
    lines = F.regexp_replace(F.array_join(plain, "\n"), r'"\n\+\n"', "")
    found = F.regexp_extract_all(lines, F.lit(r'(?m)^"((?:[^"\\\n]++|\\.)*+)"$'), F.lit(1))
    spaced = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\\[nrtf]", " "), r"\\([\"'\\])", "$1"))
    sql = F.filter(F.transform(found, lambda s: flat(spaced(s))), lambda s: F.lower(s).rlike(r"^(?:select|insert|update|delete|merge|with|call)\b"))
    return files.select(*files.columns, F.posexplode(sql).alias("nth", "sql")).withColumn("nth", F.col("nth") + 1)
