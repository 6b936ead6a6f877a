"""Secret scan with a trigram inverted index, with DataFrame functions only.

From every rule's regular expression a Boolean trigram query is derived: an OR of ANDs of (lower-cased) trigrams that each
match must contain. The index holds postings (trigram, id) of the trigrams that the rules ask for, less those that can't complete a
conjunction in their text. Postings are intersected
per conjunction by OR-ing the bits of its trigrams per id; ids that reach all bits are candidates, and only there the rule's
expression runs. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SPANS = "array<struct<start: bigint, kind_no: int, end: bigint, kind: string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is in the common part of Java's, RE2's and Python's syntax. A match counts when its ``group`` has
    ``min_chars`` characters."""

    kind: str
    pattern: str
    min_chars: int = 0
    group: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base kinds, in the order of the result.
BASE = (
    Rule("assign", "(" + "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
)
#: Published token formats.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"),
)
RULES = BASE + MORE

Query = frozenset  # of frozensets of trigrams: OR of ANDs; the query with one empty conjunction is always true
ALWAYS: Query = frozenset([frozenset()])
WIDEST = 64  # strings that one part of an expression may stand for before it is cut


def _absorb(query) -> Query:
    query = list(query)
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    return _absorb({x | y for x in a for y in b})


def _any(strings) -> Query:
    """What a text holds if it holds one of the strings."""
    return _absorb(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _letters(arg) -> set[str] | None:
    """The lower-cased characters of a class, or None where they are many."""
    out: set[str] = set()
    for op, value in arg:
        if str(op) == "LITERAL":
            out.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _strings(parts) -> set[str] | None:
    """All strings that parts of an expression stand for, or None where they are many."""
    out = {""}
    for op, arg in parts:
        name = str(op)
        if name == "LITERAL":
            more: set[str] | None = {chr(arg).lower()}
        elif name == "IN":
            more = _letters(arg)
        elif name == "SUBPATTERN":
            more = _strings(arg[3])
        elif name == "BRANCH":
            each = [_strings(b) for b in arg[1]]
            more = None if None in each else set().union(*each)
        elif name.endswith("REPEAT") and arg[1] <= 1:
            more = _strings(arg[2])
            more = None if more is None else more | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > WIDEST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _derive(parts) -> Query:
    need, run = ALWAYS, []

    def close() -> Query:
        strings = _strings(run)
        run.clear()
        return _both(need, _any(strings))

    for part in parts:
        name, arg = str(part[0]), part[1]
        if _strings([*run, part]) is not None:
            run.append(part)
            continue
        need = close()
        if _strings([part]) is not None:
            run.append(part)
        elif name == "SUBPATTERN":
            need = _both(need, _derive(arg[3]))
        elif name == "BRANCH":
            need = _both(need, _absorb(frozenset().union(*(_derive(b) for b in arg[1]))))
        elif name.endswith("REPEAT") and arg[0] >= 1:
            need = _both(need, _derive(arg[2]))
    return close()


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of lower-cased trigrams without which ``pattern`` can't match; ALWAYS where there are none."""
    return _derive(re._parser.parse(pattern))


def conjunctions(rules=RULES) -> list[tuple[int, frozenset]]:
    """(rule number, trigrams) of the rules that the index can serve."""
    out = []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if ALWAYS != query and frozenset() not in query:
            out += [(i, tris) for tris in sorted(query, key=sorted)]
    return out


def leads(trigrams: list[str], rules=RULES) -> dict[str, list[str]]:
    """Each trigram under the one that leads it: a trigram of all conjunctions that ask for it, and of those the one that leads most.

    Where the leading trigram is missing, no conjunction of those under it can be met, so they needn't be looked for."""
    asked = {t: [tris for _, tris in conjunctions(rules) if t in tris] for t in trigrams}
    beside = {t: frozenset.intersection(*sets) & set(trigrams) if sets else {t} for t, sets in asked.items()}
    most = {t: sum(t in others for others in beside.values()) for t in trigrams}
    out: dict[str, list[str]] = {}
    for t in trigrams:
        out.setdefault(max(beside[t], key=lambda x: (most[x], x)), []).append(t)
    return out


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The inverted index: (trigram number, id) for the listed trigrams, of texts that also hold the trigram that leads it.

    Texts are lowered in a projection of their own: inside the array that would be done again for each trigram."""
    number = {t: i for i, t in enumerate(trigrams)}
    holds = lambda t: F.contains("_low", F.lit(t))
    runs = [none := F.array().cast("array<int>")]
    for lead, led in leads(trigrams, rules).items():
        posted = F.array(*[F.lit(number[t]) if t == lead else F.when(holds(t), F.lit(number[t])) for t in led])
        runs.append(F.when(holds(lead), posted).otherwise(none))
    low = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_low"))
    return low.select(F.explode(F.concat(*runs)).alias("trigram"), "_id").where("trigram is not null")


def candidates(index: DataFrame, trigrams: list[str], rules=RULES) -> DataFrame:
    """(id, rules): a bit for each rule that the id's postings allow."""
    number = {t: i for i, t in enumerate(trigrams)}
    rows, full = [], []
    for c, (rule, tris) in enumerate(conjunctions(rules)):
        full.append((c, 1 << rule, (1 << len(tris)) - 1))
        rows += [(number[t], c, 1 << k) for k, t in enumerate(sorted(tris))]
    spark = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame(rows, "trigram int, conjunction int, bit long"))  # as many rows as the rules have trigrams
    goal = F.broadcast(spark.createDataFrame(full, "conjunction int, rule long, goal long"))
    met = index.join(wanted, "trigram").groupBy("_id", "conjunction").agg(F.bit_or("bit").alias("bits"))
    return met.join(goal, "conjunction").where("bits = goal").groupBy("_id").agg(F.bit_or("rule").alias("_rules"))


def find(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches as spans in code points; those that are too short are dropped afterwards.

    Starts are sums of the lengths of what lies between and of the matches before."""
    hits, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("n"), F.transform(sized, F.length).alias("sized"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        keep = F.coalesce(x["sized"] >= rule.min_chars, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, out: str = "secrets") -> DataFrame:
    """``docs`` with a column ``out``: spans (start, kind_no, end, kind) of all rules by start, then kind; ends are exclusive.

    A null text is empty. Rows with equal ids (null too) share their postings, so a rule may be tried in vain on one of them;
    the spans of every row come from its own text. An empty table gives no rows. A column called ``out`` is replaced, all
    others pass through. A text with h matches of a rule costs h squared steps of copying. The candidates are found and stored at once;
    they are broadcast to the texts where they are small, otherwise texts and candidates are joined by shuffle.
    """
    trigrams = sorted({t for _, tris in conjunctions(rules) for t in tris})
    served = {i for i, _ in conjunctions(rules)}
    # Stored, so that the planner knows their size before it decides whether the texts are shuffled to them.
    found = settle(candidates(postings(docs, trigrams, id_col, text_col, rules), trigrams, rules))
    allowed = F.coalesce(F.col("_rules"), F.lit(0))  # with a null, Spark would go on and try the expression
    text, none = F.coalesce(F.col(f"doc.{text_col}"), F.lit("")), F.array().cast(SPANS)
    spans = []
    for i, rule in enumerate(rules):
        # a character class on its own: long enough runs are all that can count
        test = text.rlike(rule.pattern.removesuffix("+") + f"{{{rule.min_chars}}}") if re.fullmatch(r"\[[^]]+\]\+", rule.pattern) else text.rlike(rule.pattern)
        test = test if i not in served else (allowed.bitwiseAND(F.lit(1 << i)) != 0) & test
        spans.append(F.when(test, find(text, rule, i)).otherwise(none))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("key"))
    joined = packed.join(found, F.col("key").eqNullSafe(F.col("_id")), "left")
    return joined.select(*[F.col(f"doc.{c}").alias(c) for c in docs.columns if c != out], F.array_sort(F.concat(*spans)).alias(out))
