"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is parsed, and the literal tokens that any URL it can match must hold as whole tokens are derived
from it (``required_tokens``), never declared. The tokens'
frequencies over all URLs pick the rarest one of each rule as its index key; a URL's tokens fetch
the few candidate rules, and only those run their regular expressions. Rules are configuration
(of ``most`` at most, on the driver), given in code or read from a file (``read_rules``); URLs are mapped where they lie, without a shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path and only rules
without literal tokens can match it; repeated rows are judged each; existing columns called
host, path, rule, matched or verdict are replaced, others are kept; an empty table gives no rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
A_TO_Z = str.maketrans(UPPER, LOWER)


def _is_word(c: int) -> bool:
    return chr(c).isascii() and chr(c).isalnum()


def _only(items: list, word: bool) -> bool:
    """Whether a character set holds word characters (ASCII letters and digits) alone, or none."""
    if not items or items[0][0] is parser.NEGATE:
        return False
    for kind, x in items:
        if kind is parser.LITERAL:
            chars = [x]
        elif kind is parser.RANGE:
            chars = range(x[0], x[1] + 1)
        else:
            return False
        if any(_is_word(c) != word for c in chars):
            return False
    return True


def _edge(seq: list, ahead: bool) -> bool:
    """Whether however the pattern's rest ``seq`` goes on (read backwards if not ``ahead``), what comes next
    is no word character or the end of the text."""
    for k, (op, arg) in enumerate(seq):
        rest = seq[k + 1 :]
        turned = lambda p: list(p) if ahead else list(p)[::-1]
        if op is parser.LITERAL:
            return not _is_word(arg)
        if op is parser.IN:
            return _only(arg, False)
        if op is parser.AT:
            return arg in ((parser.AT_END, parser.AT_END_STRING) if ahead else (parser.AT_BEGINNING, parser.AT_BEGINNING_STRING))
        if op is parser.ASSERT_NOT:
            way, p = arg
            chars = {c for kind, x in (p[0][1] if len(p) == 1 and p[0][0] is parser.IN else []) if kind in (parser.LITERAL, parser.RANGE) for c in (range(x[0], x[1] + 1) if kind is parser.RANGE else [x])}
            if way == (1 if ahead else -1) and chars >= {ord(c) for c in LOWER + "0123456789"}:
                return True
            continue
        if op is parser.SUBPATTERN:
            return _edge(turned(arg[-1]) + rest, ahead)
        if op is parser.BRANCH:
            return all(_edge(turned(p) + rest, ahead) for p in arg[1])
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            least, _, p = arg
            return _edge(turned(p) + rest, ahead) and (least > 0 or _edge(rest, ahead))
        return False
    return False  # the search may have begun or end anywhere


def required_tokens(pattern: str) -> tuple[str, ...]:
    """The runs of ASCII letters and digits (lower-cased) that every match of ``pattern`` holds with no such character
    on either side: what stands in its sequence and in groups that can't be left out."""

    def flat(seq: list) -> list:
        out = []
        for op, arg in seq:
            out += flat(list(arg[-1])) if op is parser.SUBPATTERN else [(op, arg)]
        return out

    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE or "(?i" in pattern:  # other letters can match, such as the Kelvin sign
        return ()
    seq, found, at = flat(list(parsed)), [], 0
    while at < len(seq):
        end = at
        while end < len(seq) and seq[end][0] is parser.LITERAL and _is_word(seq[end][1]):
            end += 1
        # before it a lookbehind stands as it does in the pattern, so what follows one is read past it
        if end > at and _edge(seq[:at][::-1], False) and _edge(seq[end:], True):
            found.append("".join(chr(x) for _, x in seq[at:end]).translate(A_TO_Z))
        at = max(end, at + 1)
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``host + path``. Explicit rules (``rank`` 1) win over the general patterns (``rank`` 0),
    then the longest name."""

    name: str
    verdict: str
    pattern: str
    rank: int = 0

    @property
    def tokens(self) -> tuple[str, ...]:
        return required_tokens(self.pattern)


def host_rule(verdict: str, name: str) -> Rule:
    """``host/path`` fits the host and all its subdomains where the URL's path starts with ``/path``."""
    host, path = name.split("/", 1)
    return Rule(name, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", 1)


#: Fixed values of the contract.
CONTRACT_RULES = (
    host_rule("block", "com/en/"),
    host_rule("allow", "example.com/en/7"),
    host_rule("allow", "net/de/"),
    host_rule("block", "example.net/de/8"),
    host_rule("block", "org/es/"),
)
#: General patterns of the method: spam hosts, and paths of archives or log-ins.
PATTERN_RULES = (
    Rule("spam-farm", "block", r"\A[^/]*(?<![a-z0-9])spam-farm(?![a-z0-9])"),
    Rule("cheap-pills", "block", r"\A[^/]*(?<![a-z0-9])cheap-pills(?![a-z0-9])"),
    Rule("casino", "block", r"\A[^/]*(?<![a-z0-9])casino(?![a-z0-9])"),
    Rule("login-page", "block", r"/login(?:\.php|\.html)?/?\Z"),
    Rule("zip-archive", "block", r"\.zip\Z"),
)


def read_rules(spark: SparkSession, path: str, most: int = 100_000) -> tuple[Rule, ...]:
    """Rules of a text file, a line each: verdict, kind, name and, where the kind is ``pattern``, the regular expression, by
    tabs; kind ``host`` takes its name for the rule. Empty lines and those that begin with # are passed over."""
    out = []
    for r in spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").limit(most + 1).collect():
        verdict, kind, name, *rest = r["value"].split("\t")
        if verdict not in ("allow", "block") or kind not in ("host", "pattern") or (kind == "pattern") != bool(rest) or kind == "host" and "/" not in name:
            raise ValueError(f"not a rule: {r['value']!r}")
        out.append(host_rule(verdict, name) if kind == "host" else Rule(name, verdict, "\t".join(rest)))
    if len(out) > most:
        raise ValueError(f"more than {most} rules")
    if len({r.name for r in out}) < len(out):
        raise ValueError("two rules of one name")
    return tuple(out)


def token_counts(df: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, int]:
    """How many URL tokens of the whole table equal each rule token: one pre-aggregated count."""
    wanted = sorted({t for r in rules for t in r.tokens})
    listed = df.sparkSession.createDataFrame([(t,) for t in wanted], "t string")  # bounded with the rules
    found = df.select(F.explode(F.split(F.translate(F.coalesce(F.col(url).cast("string"), F.lit("")), UPPER, LOWER), "[^a-z0-9]+")).alias("t"))
    return {r["t"]: r["n"] for r in found.join(F.broadcast(listed), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    index, always = {}, []
    for r in rules:
        if tokens := r.tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
        else:
            always.append(r)
    return index, always


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(A_TO_Z), re.match(r"[^?#]*", rest[len(host) :])[0]


def judge(index: dict[str, list[Rule]], always: list[Rule]) -> Callable[[str | None], tuple[str, str, str | None, str | None, str]]:
    compiled = {r.name: re.compile(r.pattern) for rs in [*index.values(), always] for r in rs}

    def one(url: str | None) -> tuple[str, str, str | None, str | None, str]:
        host, path = parts(url)
        text = host + path
        tokens = set(re.findall(r"[a-z0-9]+", text.translate(A_TO_Z)))
        hits = [r for t in tokens & index.keys() for r in index[t] if compiled[r.name].search(text)] + [r for r in always if compiled[r.name].search(text)]
        best = max(hits, key=lambda r: (r.rank, len(r.name), r.name), default=None)
        explicit = best.name if best and best.rank else None
        return host, path, explicit, best.name if best else None, best.verdict if best else "allow"

    return one


def url_filter(df: DataFrame, rules: tuple[Rule, ...] = CONTRACT_RULES + PATTERN_RULES, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the explicit rule that won, else null), matched (any rule) and verdict."""
    one = judge(*rule_index(rules, token_counts(df, rules, url)))

    @F.pandas_udf("host string, path string, rule string, matched string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(None if u is None or u != u else u) for u in urls], columns=["host", "path", "rule", "matched", "verdict"])

    names = ["host", "path", "rule", "matched", "verdict"]
    kept = [c for c in df.columns if c.lower() not in names]
    return df.select(*kept, judged(F.col(url).cast("string")).alias("__judged")).select(*kept, *(F.col(f"__judged.{c}").alias(c) for c in names))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r as (
  select *, case
    when ('.' || host) like '%.example.com' and starts_with(path, '/en/7') then 'example.com/en/7'
    when ('.' || host) like '%.example.net' and starts_with(path, '/de/8') then 'example.net/de/8'
    when ('.' || host) like '%.com' and starts_with(path, '/en/') then 'com/en/'
    when ('.' || host) like '%.net' and starts_with(path, '/de/') then 'net/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/es/') then 'org/es/' end as rule
  from p)
select page_id, host, path, rule,
  case when rule in ('example.com/en/7', 'net/de/') then 'allow'
       when rule is not null then 'block'
       when regexp_matches(host, '(^|[^a-z0-9])(spam-farm|cheap-pills|casino)($|[^a-z0-9])') then 'block'
       when regexp_matches(path, '/login(\.php|\.html)?/?$') or regexp_matches(path, '\.zip$') then 'block'
       else 'allow' end as verdict
from r
"""
