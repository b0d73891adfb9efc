"""Verdicts on URLs by a bit-parallel automaton over wildcard rules.

All rules are packed into one row of bits, spread over 64-bit words. Bit k of a
rule says that its first k characters have just been matched. A character moves
all bits on at once (Shift-And); a wildcard is a bit that also stays where it
is. ``*`` stays on any character but ``/`` and ``?``, and ``**`` on any. Texts
of a batch are stepped together, a character of each at a time.

A canonical URL is a dot, the host in lower case, ``?`` and the path. The dot
makes ``*.com`` fit ``com`` and all hosts below it; ``?``, which neither host
nor path can hold, keeps the two apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import fresh, quoted

#: Characters from here on share one column of the tables unless a rule names them.
_OTHER = 0


#: So many texts or fewer are taken one by one.
FEW = 4


@dataclass(frozen=True)
class Rule:
    """A wildcard rule over canonical URLs. name: shown in results; weight: the fitting rule with most weight wins, the first of equals."""

    glob: str
    verdict: str
    name: str | None
    weight: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A host, its subdomains, and the paths that start with ``path``; the longest such rule outweighs all others."""
    if "*" in host + path:
        raise ValueError("a host rule has no wildcards")
    return Rule(f"*.{host.lower()}?{path}**", verdict, host + path, 1_000_000 + len(host) + len(path))


def glob_rule(host: str, path: str, verdict: str) -> Rule:
    """Wildcards over the host (behind its dot) and the path, without a name."""
    return Rule(f"{host}?{path}", verdict, None, 0)


class Automaton:
    """All rules at once."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        steps: list[tuple[str, bool, bool]] = []  # of each bit: the character that leads to it, whether * or ** stays on it
        self.first, self.last = [], []
        for rule in rules:
            self.first.append(len(steps))
            steps.append(("", False, False))
            k = 0
            while k < len(rule.glob):
                if rule.glob[k] == "*":
                    wide = rule.glob[k : k + 2] == "**"
                    char, any_, one = steps[-1]
                    steps[-1] = (char, any_ or wide, one or not wide)
                    k += 1 + wide
                else:
                    steps.append((rule.glob[k], False, False))
                    k += 1
            self.last.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        chars = sorted({c for c, _, _ in steps if c} | {"/", "?"})
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        self.move = np.zeros((len(chars) + 1, self.words), dtype=np.uint64)
        self.stay = np.zeros((len(chars) + 1, self.words), dtype=np.uint64)
        for k, (char, any_, one) in enumerate(steps):
            w, bit = k // 64, np.uint64(1 << k % 64)
            if char:
                self.move[self.code[char], w] |= bit
            if any_:
                self.stay[:, w] |= bit
            elif one:
                self.stay[[k for c, k in [("", _OTHER), *self.code.items()] if c not in ("/", "?")], w] |= bit
        self.start = np.zeros(self.words, dtype=np.uint64)
        for k in self.first:
            self.start[k // 64] |= np.uint64(1 << k % 64)
        self.order = sorted(range(len(rules)), key=lambda k: (-rules[k].weight, k))

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        table = np.zeros(max((ord(c) for c in self.code), default=0) + 2, dtype=np.int64)
        for c, k in self.code.items():
            table[ord(c)] = k
        return table[np.minimum(points, len(table) - 1)], np.array([len(t) for t in texts], dtype=np.int64)

    def _finish(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after the rest of one text."""
        moves, stays = ([int.from_bytes(row.astype("<u8").tobytes(), "little") for row in table] for table in (self.move, self.stay))
        x = int.from_bytes(state.astype("<u8").tobytes(), "little")
        for c in codes.tolist():
            x = x << 1 & moves[c] | x & stays[c]
        return np.frombuffer(x.to_bytes(8 * self.words, "little"), dtype="<u8")

    def winners(self, texts: list[str]) -> np.ndarray:
        """Of each canonical URL the number of the rule that wins, -1 if none fits."""
        codes, sizes = self._codes(texts)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        longest_first = np.argsort(-sizes, kind="stable")
        starts, sorted_sizes = starts[longest_first], sizes[longest_first]
        state = np.tile(self.start, (len(texts), 1))
        top = np.uint64(63)
        for pos in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sorted_sizes, -pos, side="left"))
            if live <= FEW:  # what is left of a few long ones goes on one by one, the masks as whole numbers
                for k in range(live):
                    state[k] = self._finish(state[k], codes[starts[k] + pos : starts[k] + sorted_sizes[k]])
                break
            c = codes[starts[:live] + pos]
            old = state[:live]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> top
            state[:live] = (moved & self.move[c]) | (old & self.stay[c])
        won = np.full(len(texts), -1, dtype=np.int64)
        for k in self.order:
            w, bit = self.last[k] // 64, np.uint64(1 << self.last[k] % 64)
            fits = (state[:, w] & bit) != 0
            won[longest_first[fits & (won[longest_first] < 0)]] = k
        return won


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (behind the first ``://``, A-Z in lower case) and path (from there to ``?`` or ``#``); both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    behind = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(behind, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: list[Rule], default: str, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the winner's name, null if it has none) and verdict (its own, else ``default``).

    Null URLs and those without ``://`` have an empty host and path and are
    judged like any other. Repeated rows and all columns stay, but columns
    called like a new one are replaced. A URL of any length is one row's work.
    """
    automaton = Automaton(rules)

    @F.pandas_udf("int")
    def winner(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            texts = ["." + h + "?" + p for h, p in zip(hosts, paths, strict=True)]
            yield pd.Series(automaton.winners(texts), dtype="int32")

    h, p, k = fresh(pages, "_host", "_path", "_rule")
    host, path = host_and_path(quoted(url_col))
    found = pages.withColumns({h: host, p: path}).withColumn(k, winner(F.col(h), F.col(p)))
    names = F.array(*[F.lit(r.name).cast("string") for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    new = {
        "host": F.col(h),
        "path": F.col(p),
        "rule": F.when(F.col(k) >= 0, F.get(names, F.col(k))),
        "verdict": F.when(F.col(k) >= 0, F.get(verdicts, F.col(k))).otherwise(default),
    }
    keep = [quoted(c) for c in pages.columns if c.lower() not in new]
    return found.select(*keep, *[v.alias(n) for n, v in new.items()])
