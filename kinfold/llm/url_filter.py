r"""URL filters: a bit-parallel Shift-And automaton over all wildcard rules at once.

Rules are globs over the canonical string ``.host/path`` (a dot, the lower-case host, the
path): ``*`` stands for any characters but ``/``, ``**`` for any characters, ``?`` for one
character but ``/``; anything else for itself. Each rule takes one bit a symbol, and all
rules together fill as many 64-bit words as they need. For each symbol read, the states of
all rules advance by one shift, and one mask a character says which positions accept it;
bits of wildcards also stay where they are. A block of URLs is advanced together, one
symbol position a step, so the work is (longest URL) x (words) vector operations.

Defined results: host and path of a null url, or one without ``://``, are empty strings,
which fit no rule that names a host. Texts of any length are judged whole, in blocks of
like length. Characters outside ASCII count as one symbol class that only wildcards take,
unless a rule names them. Repeated rows get equal results; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    """A glob with its verdict; the one with the highest priority (then the first) wins."""

    name: str | None
    glob: str
    verdict: str
    priority: int


def host_rule(target: str, verdict: str) -> UrlRule:
    """A rule like ``example.com/en/``: its host and all subdomains, paths that start with its path."""
    if "/" not in target or any(c in target for c in "*?"):
        raise ValueError(f"not a host and path: {target}")
    return UrlRule(target, f"*.{target}**", verdict, 1000 + len(target))


#: Host and path rules, longest first by priority.
HOST_RULES = (
    host_rule("com/", "allow"), host_rule("example.com/en/", "block"), host_rule("www.example.com/en/", "allow"), host_rule("net/es/", "block"),
    host_rule("net/fr/", "block")
)
#: Patterns that block what no host rule judges: binaries and archives, log-in and basket pages, hosts in punycode.
GLOB_RULES = tuple(
    UrlRule(None, g, "block", 1) for g in (
        "**.exe", "**.zip", "**.iso", "**.mp4", "*/login/**", "*/**/login/**", "*/cart/**", "*/**/cart/**", "*.xn--*/**"
    )
)
DEFAULT = "allow"


class Automaton:
    """All rules packed into words of 64 bits."""

    def __init__(self, rules: Sequence[UrlRule]) -> None:
        self.rules = tuple(rules)
        symbols: list[tuple[str, str]] = []  # of each position: kind and character
        first, last = [], []
        for rule in self.rules:
            first.append(len(symbols))
            g, i = rule.glob, 0
            symbols.append(("start", ""))
            while i < len(g):
                if g.startswith("**", i):
                    symbols[-1] = (symbols[-1][0], symbols[-1][1]) if symbols[-1][0].endswith("+any") else (
                        symbols[-1][0].split("+")[0] + "+any", symbols[-1][1]
                    )
                    i += 2
                elif g[i] == "*":
                    if "+" not in symbols[-1][0]:
                        symbols[-1] = (symbols[-1][0] + "+part", symbols[-1][1])
                    i += 1
                else:
                    symbols.append(("one", "") if g[i] == "?" else ("is", g[i]))
                    i += 1
            last.append(len(symbols) - 1)
        self.size = len(symbols)
        self.words = max(1, -(-self.size // 64))
        self.alphabet = {c: i for i, c in enumerate(sorted({c for _, c in symbols if c} | {"/"} | {chr(x) for x in range(128)}))}
        other = len(self.alphabet)  # any character that no rule names
        self.step = np.zeros((other + 2, self.words), np.uint64)  # positions that a character leads to
        self.stay = np.zeros((other + 2, self.words), np.uint64)  # positions whose wildcard takes it
        self.other, self.end = other, other + 1  # the end symbol changes nothing
        slash = self.alphabet["/"]
        for at, (kind, char) in enumerate(symbols):
            word, bit = at // 64, np.uint64(1 << (at % 64))
            for c in range(other + 1):
                if kind.startswith("is") and self.alphabet.get(char) == c or kind.startswith("one") and c != slash:
                    self.step[c, word] |= bit
                if kind.endswith("+any") or kind.endswith("+part") and c != slash:
                    self.stay[c, word] |= bit
        self.begin = self._mask(first)
        self.accept = [(a // 64, np.uint64(1 << (a % 64))) for a in last]
        self.order = sorted(range(len(self.rules)), key=lambda r: (-self.rules[r].priority, r))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def codes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of symbol numbers for each text, padded with the end symbol, and lengths."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.array([ord(c) for c in self.alphabet], np.uint32)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], points), len(known) - 1)
        flat = np.where(known[order][at] == points, np.array(list(self.alphabet.values()))[order][at], self.other)
        out = np.full((len(texts), int(lengths.max(initial=0))), self.end, np.int32)
        out[np.arange(out.shape[1]) < lengths[:, None]] = flat
        return out, lengths

    def winners(self, texts: Sequence[str]) -> np.ndarray:
        """The number of the rule that wins for each text, -1 where none matches."""
        codes, lengths = self.codes(texts)
        state = np.repeat(self.begin[None, :], len(texts), axis=0)
        for i in range(codes.shape[1]):
            live = lengths > i
            c = codes[:, i]
            moved = state << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)  # carry between words
            state = np.where(live[:, None], (moved & self.step[c]) | (state & self.stay[c]), state)
        out = np.full(len(texts), -1, np.int64)
        for r in self.order[::-1]:
            word, bit = self.accept[r]
            out[(state[:, word] & bit) != 0] = r
        return out

    def match(self, texts: Sequence[str], block: int = 4096, cells: int = 4_000_000) -> np.ndarray:
        """As :meth:`winners`, in blocks of like length that hold at most ``cells`` symbols."""
        by_length = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        out, at = np.full(len(texts), -1, np.int64), 0
        while at < len(by_length):
            end = min(len(by_length), at + block)
            while end > at + 1 and (end - at) * len(texts[by_length[end - 1]]) > cells:
                end = at + (end - at) // 2
            chosen = by_length[at:end]
            out[chosen] = self.winners([texts[i] for i in chosen])
            at = end
        return out


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: Sequence[UrlRule] = HOST_RULES,
    glob_rules: Sequence[UrlRule] = GLOB_RULES, default: str = DEFAULT
) -> DataFrame:
    """id, host, path, rule (name of the host rule that wins, else null) and verdict of each page."""
    rules = [*host_rules, *glob_rules]
    url = F.col(url_col).cast("string")
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    schema = pa.schema([("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        names = np.array([r.name for r in rules] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in rules] + [default], dtype=object)
        for batch in (whole.slice(a, 4096) for whole in batches for a in range(0, whole.num_rows, 4096)):
            won = automaton.match([f".{h}{p}" if h else "" for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])
            yield pa.record_batch(
                [*batch.columns, pa.array(names[won], schema[0].type), pa.array(verdicts[won], schema[1].type)],
                names=["id", "host", "path", "rule", "verdict"]
            )

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return narrow.mapInArrow(judge, "id long, host string, path string, rule string, verdict string")
