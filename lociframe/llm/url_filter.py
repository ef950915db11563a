"""URL filters by pattern rules that are indexed by their rarest literal token, with DataFrame functions only.

A rule is a pattern over host and path. * stands for any characters, ^ for a separator (a character that is no letter or
digit and none of _ . % -) or the end; a leading || anchors the pattern at the host or any of its subdomains, a leading |
at the start, a closing | at the end. parse reads it from a line, in which @@ makes it an exception, whose rule allows and
goes before all that block. Each rule is filed under that of its literal tokens (runs of a-z, 0-9 with a border on both
sides that the pattern fixes) which the fewest of all the table's URLs hold. A URL's own tokens fetch the rules filed under
them, and only these run their regular expression.

Up to INLINE rules the index is one constant array of buckets, sized by the rules, so a row is judged where it is read: no
join, no shuffle. More rules are a table that a URL's tokens are joined to. Rules without a token, which every URL must
try, are constants.

Defined results: host is what follows the first :// up to / ? # or the end, A-Z lower-cased, path what then follows up
to ? # or the end; both are empty for a null URL or one without ://, which no rule fits. Among fitting rules the higher
priority wins, then the longer pattern, then the greater string. Rows, repeats and further columns
stay; a column that has an added one's name gives way to it.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import ascii_lower, cut, literal_table, own_prefix

#: Rules that travel with the query, and rows that one part of a larger table has.
INLINE = 20_000

#: What ^ stands for.
SEPARATOR = "(?:[^a-zA-Z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str
    priority: int = 0

    @property
    def literal(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def _parts(self) -> tuple[str, str, str]:
        """Where it starts (||, | or nothing), its body, and where it ends (| or nothing)."""
        head = "||" if self.pattern.startswith("||") else "|" if self.pattern.startswith("|") else ""
        body = self.pattern[len(head) :]
        return head, body.removesuffix("|"), "|" if body.endswith("|") else ""

    @property
    def regex(self) -> str:
        """For host and path side by side."""
        head, body, tail = self._parts
        made = "".join({"*": ".*", "^": SEPARATOR}.get(x, re.escape(x)) for x in re.split("([*^])", body))
        return {"||": r"^(?:[^/]*\.)?", "|": "^", "": ""}[head] + made + ("$" if tail else "")

    @property
    def tokens(self) -> set[str]:
        """Tokens that every URL which the rule fits holds whole."""
        head, body, tail = self._parts
        found, text = set(), body.lower()
        for m in re.finditer("[a-z0-9]+", text):
            before = text[m.start() - 1] if m.start() else "." if head else "*"
            after = text[m.end()] if m.end() < len(text) else "|" if tail else "*"
            if "*" not in (before, after):
                found.add(m[0])
        return found


def parse(line: str, priority: int = 0) -> Rule | None:
    """The rule of a line; None for one that is empty or a comment (!). An exception's priority is one higher."""
    text = line.strip()
    if not text or text.startswith("!"):
        return None
    return Rule(text[2:], "allow", priority + 1) if text.startswith("@@") else Rule(text, "block", priority)


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+"))


def _parted(rows: list[dict]) -> list[list[dict]]:
    return [rows[k : k + INLINE] for k in range(0, len(rows), INLINE)] or [[]]


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many of all the URLs each of these tokens occurs; no more rows than tokens come back."""
    if not tokens:
        return {}
    host, path = host_path(F.col(f"`{url}`"))
    parts = _parted([{"token": t} for t in sorted(tokens)])
    asked = literal_table(urls.sparkSession, parts, "token:string")
    held = urls.select(F.explode(_tokens(F.concat(host, path))).alias("token"))
    met = held.groupBy("token").agg(F.count("*").alias("n")).join(F.broadcast(asked) if len(parts) == 1 else asked, "token")
    return {r["token"]: r["n"] for r in met.collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """The rules, each with the token that it is filed under, and the rules without a token, which every URL must try."""
    filed, loose = [], []
    for r in rules:
        entry = {"priority": r.priority, "size": len(r.literal), "rule": r.literal, "action": r.action, "regex": r.regex}
        if own := r.tokens:
            filed.append(entry | {"token": min(own, key=lambda t: (counts.get(t, 0), t))})
        else:
            loose.append(entry | {"token": ""})
    return filed, loose


ENTRY = "token:string,priority:int,size:int,rule:string,action:string,regex:string"


def _best(fits: Column) -> Column:
    return F.array_max(F.transform(fits, lambda r: F.struct(r["priority"].alias("priority"), r["size"].alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, and of the winning rule its literal, priority and action (default where none fits)."""
    counts = token_counts(urls, url, set().union(*[r.tokens for r in rules]) if rules else set())
    filed, loose = index(rules, counts)
    tried = F.from_json(F.lit(json.dumps(loose)), f"array<struct<{ENTRY}>>")
    host, path = host_path(F.col(f"`{url}`"))
    p = own_prefix(urls)
    target, tokens, won, uid, token = (f"{p}{x}" for x in ("target", "tokens", "won", "uid", "token"))
    made = urls.drop("host", "path", "rule", "rule_priority", "action").withColumns({"host": host, "path": path})
    made = made.withColumn(target, F.concat("host", "path")).withColumn(tokens, _tokens(F.col(target)))

    def runs(r: Column) -> Column:
        return F.rlike(F.col(target), r["regex"]) & (F.col("host") != "")

    if len(filed) <= INLINE:
        width = max(1, 2 * len(filed))
        held: list[list[dict]] = [[] for _ in range(width)]
        for entry in filed:
            held[zlib.crc32(entry["token"].encode()) % width].append(entry)
        buckets = F.from_json(F.lit(json.dumps(held)), f"array<array<struct<{ENTRY}>>>")  # folded to a constant before it runs
        fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.element_at(buckets, (F.crc32(t.cast("binary")) % width + 1).cast("int")), lambda r: r["token"] == t)))
        made = made.withColumn(won, _best(F.filter(F.concat(fetched, tried), runs)))
    else:
        table = literal_table(urls.sparkSession, _parted(filed), ENTRY)
        made = cut(made.withColumn(uid, F.monotonically_increasing_id()))
        asked = made.where(F.col("host") != "").select(uid, target, F.explode(tokens).alias(token))
        met = asked.join(table.withColumnRenamed("token", token), token).where(F.rlike(F.col(target), F.col("regex")))
        best = met.groupBy(uid).agg(F.max(F.struct("priority", "size", "rule", "action")).alias(won))
        other = _best(F.filter(tried, runs))
        made = made.join(best, uid, "left").withColumn(won, F.array_max(F.array(F.col(won), other))).drop(uid)
    made = made.withColumns({"rule": F.col(f"{won}.rule"), "rule_priority": F.col(f"{won}.priority"), "action": F.coalesce(f"{won}.action", F.lit(default))})
    return made.drop(won, target, tokens)
