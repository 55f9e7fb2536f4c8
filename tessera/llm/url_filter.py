"""URL filter: all glob rules at once by a bit-parallel wildcard automaton (multiword Shift-And)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import LOWER, UPPER

#: Input symbols: 0-255 bytes, SEP between host and path (no byte can stand for it).
SEP, STAR, ANY, SYMBOLS = 256, -1, -2, 257
DOWN = str.maketrans(UPPER, LOWER)

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
DEFAULT_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over "host + path" that block where no rule fits.
DEFAULT_BLOCK_GLOBS = ("*spam*", "*pills*", "*casino*", "*malware*")


def canonical(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    return host.translate(DOWN), tail[: min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))]


def glob_symbols(glob: str) -> list[int]:
    """Symbols of a glob over host + path: * any run, ? any one symbol, else the bytes."""
    out: list[int] = []
    for c in glob:
        out += [STAR] if c == "*" else [ANY] if c == "?" else list(c.encode())
    return out


def rule_symbols(host: str, path: str) -> list[int]:
    """The rule as a glob over "." + host, SEP, path."""
    return [STAR, *f".{host}".encode(), SEP, *path.encode(), STAR]


@dataclass(frozen=True)
class Automaton:
    """State i of a pattern: its first i symbols are matched. All states of all patterns lie in one row of 64-bit words."""

    steps: np.ndarray  # SYMBOLS x words: states that may be entered on a symbol
    loops: np.ndarray  # words: states before a *, which stay
    start: np.ndarray  # words
    final: np.ndarray  # pattern: its last state's bit position

    @classmethod
    def of(cls, patterns: list[list[int]]) -> Automaton:
        sizes = [sum(s != STAR for s in p) + 1 for p in patterns]
        words = max(1, -(-sum(sizes) // 64))
        steps, loops, start = np.zeros((SYMBOLS, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        final, at = [], 0
        for p in patterns:
            start[at >> 6] |= np.uint64(1) << np.uint64(at & 63)
            for s in p:
                bit = np.uint64(1) << np.uint64((at + (s != STAR)) & 63)
                if s == STAR:
                    loops[at >> 6] |= bit
                    continue
                at += 1
                if s == ANY:
                    steps[:SEP, at >> 6] |= bit
                else:
                    steps[s, at >> 6] |= bit
            final.append(at)
            at += 1
        return cls(steps, loops, start, np.array(final, np.int64))

    def accepts(self, texts: list[list[int] | np.ndarray]) -> np.ndarray:
        """texts x patterns booleans. Texts step together, longest first; each step is a few operations on whole columns."""
        n = len(texts)
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        live = np.tile(self.start, (n, 1))
        top = int(lens.max()) if n else 0
        flat = np.concatenate([np.asarray(t, np.int64) for t in texts]) if n else np.zeros(0, np.int64)
        begin = (np.cumsum(lens) - lens)[order]
        going = np.searchsorted(-lens[order], -np.arange(top), side="left")  # how many texts are longer than t
        for t in range(top):
            m = going[t]
            now = live[:m]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            live[:m] = (moved & self.steps[flat[begin[:m] + t]]) | (now & self.loops)
        hit = (live[:, self.final >> 6] >> (self.final & 63).astype(np.uint64)) & np.uint64(1)
        out = np.zeros((n, len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def url_filter(pages: DataFrame, rules=DEFAULT_RULES, block_globs=DEFAULT_BLOCK_GLOBS, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern: the longest fitting rule's verdict, else block if a glob fits, else allow.

    Null or scheme-less urls have an empty host and path, fit no rule and are judged by the globs alone. Null ids
    stay, repeated rows are judged each, an empty table gives an empty one, other columns are not read. Rules of one
    length: the earlier wins. Urls of any length are judged whole.
    """
    labels = [f"{h}{p}" for _, h, p in rules]
    by_length = sorted(range(len(rules)), key=lambda i: -len(labels[i]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact = Automaton.of([rule_symbols(h, p) for _, h, p in rules])
        loose = Automaton.of([glob_symbols(g) for g in block_globs])
        for b in batches:
            both = [canonical(u) for u in b["url"]]
            strict = [np.r_[np.frombuffer(f".{h}".encode(), np.uint8).astype(np.int64), SEP, np.frombuffer(p.encode(), np.uint8).astype(np.int64)] for h, p in both]
            fits = exact.accepts(strict)
            globs = loose.accepts([np.frombuffer((h + p).encode(), np.uint8) for h, p in both]) if block_globs else np.zeros((len(both), 0), bool)
            rule, verdict, pattern = [], [], []
            for f, g in zip(fits, globs):
                won = next((i for i in by_length if f[i]), None)
                glob = next((block_globs[i] for i in np.flatnonzero(g)), None)
                rule.append(None if won is None else labels[won])
                pattern.append(glob)
                verdict.append(("block" if glob else "allow") if won is None else rules[won][0])
            yield pd.DataFrame({"page_id": b["page_id"], "host": [h for h, _ in both], "path": [p for _, p in both], "rule": rule, "verdict": verdict, "pattern": pattern})

    kind = pages.schema[page_id].dataType.simpleString()
    # ids go through Python as strings, which are exact beside nulls
    found = pages.select(pages[page_id].cast("string").alias("page_id"), pages[url].alias("url")).mapInPandas(judge, "page_id string, host string, path string, rule string, verdict string, pattern string")
    return found.withColumn("page_id", found["page_id"].cast(kind))
