"""Secret scan through a trigram inverted index.

Only DataFrame and SQL functions. Each rule's regex is compiled to a Boolean query
over trigrams: a list of clauses, of which one must hold, each a set of trigrams
that must all occur. The query is derived from the regex's syntax tree: strings that
a match must hold, with all alternatives of small classes, branches and optional
parts, between the parts that may be anything. The index has a posting (trigram,
document) for every trigram that some rule asks for; a clause's postings are
intersected by counting them for each document. Only documents that pass are verified
with that rule's regex. Rules without mandatory trigrams, such as bare hexadecimal
runs, scan every text.

Postings leave the texts behind: a number and the id a row. Nulls: a null text is
empty, a null id is a key of its own. Rows that share an id share candidates and are
each verified on their own whole text, however long; equal rows give equal spans, and
spans of equal start come in the order of the rules. An empty table gives no rows.
Extra columns are untouched; helper columns begin with ``__pm_``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import HIDE, table, text_or_empty


#: Alternatives of one stretch up to which a query tells them apart, and clauses of a query.
MOST_ALTERNATIVES, MOST_CLAUSES = 32, 64


class _Stretches:
    """Walks a regex's syntax tree and keeps, for each stretch of known text in it, the strings of which one must occur."""

    def __init__(self) -> None:
        self.done: list[frozenset[str]] = []
        self.now = {""}

    def flush(self) -> None:
        """Ends a stretch: what follows may be anything."""
        if all(len(x) >= 3 for x in self.now):
            self.done.append(frozenset(self.now))
        self.now = {""}

    def add(self, strings: set[str]) -> None:
        if len(self.now) * len(strings) > MOST_ALTERNATIVES:
            self.flush()
        if len(strings) <= MOST_ALTERNATIVES:
            self.now = {a + b for a in self.now for b in strings}

    def walk(self, tree) -> None:
        for op, value in tree:
            name = str(op)
            exact = _exact([(op, value)])
            if exact is not None:
                self.add(exact)
            elif name == "SUBPATTERN":
                self.walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0]:
                # once for certain, then maybe more
                self.walk(value[2])
                self.flush()
            elif name != "AT":
                self.flush()


def _exact(tree) -> set[str] | None:
    """All strings, in lower case, that a part of the tree can match, if they are few."""
    out = {""}
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            part = {chr(value).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
            ranges = [(v, v) if str(o) == "LITERAL" else v for o, v in value]
            if sum(b - a + 1 for a, b in ranges) > MOST_ALTERNATIVES:
                return None
            part = {chr(c).lower() for a, b in ranges for c in range(a, b + 1)}
        elif name == "BRANCH":
            parts = [_exact(x) for x in value[1]]
            if any(x is None for x in parts):
                return None
            part = set().union(*parts)
        elif name == "SUBPATTERN":
            part = _exact(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[1] <= 8 and (one := _exact(value[2])) is not None and len(one) ** value[1] <= MOST_ALTERNATIVES:
            part = {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
        else:
            return None
        if part is None or len(out) * len(part) > MOST_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out


@lru_cache(maxsize=256)
def trigram_query(regex: str) -> tuple[frozenset[str], ...]:
    """Disjunctive normal form of the trigrams that a match of ``regex`` must hold, in lower case; () if there are none."""
    found = _Stretches()
    found.walk(re._parser.parse(regex))
    found.flush()
    out = [frozenset()]
    for strings in found.done:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        if len(out) * len(grams) <= MOST_CLAUSES:
            out = [a | b for a in out for b in grams]
    # a clause that asks for more than another is not needed
    least = [c for c in dict.fromkeys(out) if not any(d < c for d in out)]
    return tuple(least) if found.done else ()


@dataclass(frozen=True)
class Rule:
    """A regex that Java and Python read alike."""

    kind: str
    regex: str
    #: A match counts if this group is at least so long.
    group: int = 0
    least: int = 1

    def clauses(self) -> list[frozenset[str]]:
        return list(trigram_query(self.regex))


#: Kinds in the order in which spans of equal start are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
)
BASE = ("assign", "access", "hex")


def queries(rules=RULES) -> list[tuple[int, int, frozenset[str]]]:
    """(rule, clause, trigrams) of all rules that have mandatory trigrams."""
    return [(r, c, grams) for r, rule in enumerate(rules) for c, grams in enumerate(rule.clauses())]


def postings(docs: DataFrame, text: str, doc: str, rules=RULES) -> DataFrame:
    """(gram, doc): the part of the inverted index that the rules ask for."""
    grams = sorted({g for _, _, clause in queries(rules) for g in clause})
    low = F.lower(text_or_empty(text))
    found = F.filter(F.array(*map(F.lit, range(len(grams)))), lambda i: F.element_at(F.col(HIDE + "has"), i + 1))
    has = F.array(*(F.contains(low, F.lit(g)) for g in grams))
    return docs.select(F.col(doc), has.alias(HIDE + "has")).select(doc, F.explode(found).alias("gram"))


def candidates(docs: DataFrame, text: str, doc: str, rules=RULES) -> DataFrame:
    """(doc, rules): which rules' Boolean queries the document passes. Intersects postings by counting."""
    wanted = queries(rules)
    grams = sorted({g for _, _, clause in wanted for g in clause})
    asks = [[(r, c) for r, c, clause in wanted if g in clause] for g in grams]
    # the query side is the fixed rule set: a literal that each posting looks itself up in
    pair = "array<struct<r:int,c:int>>"
    lists = F.array(*(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ask)).cast(pair) for ask in asks))
    hits = postings(docs, text, doc, rules).select(doc, "gram", F.explode(F.element_at(lists, F.col("gram") + 1)).alias("q")).groupBy(doc, "q").agg(F.count_distinct("gram").alias("n"))
    need = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(len(g)).alias("n")) for r, c, g in wanted))
    passed = hits.filter(F.exists(need, lambda w: (w["r"] == F.col("q")["r"]) & (w["c"] == F.col("q")["c"]) & (F.col("n") >= w["n"])))
    return passed.groupBy(doc).agg(F.collect_set(F.col("q")["r"]).alias(HIDE + "rules"))


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (start, end, kind number) in code points, of all leftmost non-overlapping matches that are long enough.

    The text between matches, from ``split``, gives the places: match i starts
    after the pieces and matches before it.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    pieces = F.split(text, rule.regex, -1)
    item = F.arrays_zip(whole.alias("m"), F.slice(pieces, 1, F.size(whole)).alias("p"), kept.alias("g"))
    state = F.struct(F.array().cast("array<struct<s:int,e:int,k:int>>").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("s"), end.alias("e"), F.lit(kind).alias("k")))
        return F.struct(F.when(F.length(x["g"]) >= rule.least, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"), end.alias("at"))

    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    return F.when(F.rlike(text, F.lit(rule.regex)), F.aggregate(item, state, step)["out"]).otherwise(none)


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """``docs`` with ``__pm_spans``: array of (s, e, k), sorted by start and then kind."""
    found = candidates(docs, text, id_col, rules).withColumnRenamed(id_col, HIDE + "id")
    joined = docs.join(found, docs[id_col].eqNullSafe(found[HIDE + "id"]), "left")
    value = text_or_empty(text)
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    parts = []
    for n, rule in enumerate(rules):
        own = spans(value, rule, n)
        parts.append(own if not rule.clauses() else F.when(F.array_contains(HIDE + "rules", F.lit(n)), own).otherwise(none))
    order = lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"])
    return joined.select(*(docs[c] for c in docs.columns), F.array_sort(F.concat(*parts), order).alias(HIDE + "spans"))


def digest(found: Column, rules=RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def query(spark, sf_dir) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col(HIDE + "spans").alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long").alias(f"n_{BASE[k]}")
    base = F.filter("s", lambda x: x["k"] < len(BASE))
    return found.select("doc_id", *map(count, range(len(BASE))), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("s")).alias("spans"))


def _sql_spans(n: int, rule: Rule) -> str:
    """SQL list of (start, end, kind) of a rule: places from the lengths of the pieces between matches."""
    regex = rule.regex.replace("'", "''")
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda q: length(q))), 0)"
    start = f"({length('p[1:i]')} + {length('m[1:i - 1]')})::BIGINT"
    own = f"list_transform(list_filter(range(1, len(m) + 1), lambda i: length(g[i]) >= {rule.least}), lambda i: {{'s': {start}, 'k': {n}, 'e': {start} + length(m[i])}})"
    return f"(SELECT {own} FROM (SELECT regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {rule.group}) AS g, string_split_regex(t, '{regex}') AS p))"


_SPANS = ", ".join(_sql_spans(n, r) for n, r in enumerate(RULES))
_NAMES = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_JOINED = f"coalesce(array_to_string(list_transform({{0}}, lambda x: {_NAMES}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, list_sort(flatten([{_SPANS}])) AS s FROM d)
SELECT doc_id, {', '.join(f"len(list_filter(s, lambda x: x.k = {n})) AS n_{k}" for n, k in enumerate(BASE))},
  sha256({_JOINED.format(f'list_filter(s, lambda x: x.k < {len(BASE)})')}) AS base_sha256, {_JOINED.format('s')} AS spans FROM a
"""
