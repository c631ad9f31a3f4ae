"""Statistics of texts, and the nearest structural profile: prose, list, table or junk.

What documents of one language repeat at their edges (menus, notices, footers)
is counted over all documents and taken off first. The rest of a text is turned
into distributions: kinds of words, classes of characters, letters, runs of
words that are new, ranks of words, lengths of lines, ends of lines, and columns.
Profiles of the same distributions are fitted to all documents: they start from
the shares below, and texts move the profile they are nearest to. A text gets
the kind of the profile that it is nearest to by the sum of the Jensen-Shannon
divergences. Every text is read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import checkpoint, drop_checkpoint

WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
LINES = re.compile(r"[\n\r\x85\u2028]+")
SPLIT = re.compile(r"\s*(?:[|·•>»/–—-]|\s{2,}|\t)\s*")
DIGIT = re.compile(r"\d")
NUMERIC = re.compile(r"[-+]?\d[\d.,:/%-]*|[A-Z]{2,5}-\d+")
SENTENCE = re.compile(r"[.!?…:;,][\"”»’')]*\s*$")
CP1252 = frozenset("€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")
COLUMN_MARKS = ("\t", "|", ";", " / ", ",", "  ")

#: Rounds of moving the profiles.
ROUNDS = 4
#: Sums of shares are kept in whole parts of this size, so that they do not depend on the order of the documents.
PART = 2.0**-40
#: Rows of shares that are compared with the profiles at once.
ROWS = 256
#: Lines at the top and the bottom of a text that count as its edges, and the share of a language's documents that repeat boilerplate.
TOP, BOTTOM = 14, 2
REPEATED = 0.06
#: Documents of a language below which nothing is learned from it, and the share of them that hold a common word.
LEAST = 20
COMMON = 0.25
#: Characters without a blank that are no word, and words below which repetition says nothing.
UNBROKEN = 34
FEW = 20

# Blocks of the distributions with their names and weights.
BLOCKS = {
    "words": (("common", "other", "number", "mark", "unbroken"), 1.0),
    "classes": (("lower", "upper", "digit", "blank", "stop", "mark", "unreadable", "strange"), 2.0),
    "letters": (tuple("abcdefghijklmnopqrstuvwxyz") + ("else",), 1.0),
    "runs": (("new", "again"), 2.0),
    "ranks": (("top", "next", "rest"), 1.0),
    "lengths": (("16", "32", "48", "80", "160", "long"), 1.0),
    "ends": (("stop", "open"), 0.3),
    "columns": (("divided", "plain"), 2.0),
}
SPAN = {}
for _name, (_parts, _) in BLOCKS.items():
    _at = sum(b - a for a, b in SPAN.values())
    SPAN[_name] = (_at, _at + len(_parts))
WIDTH = sum(len(parts) for parts, _ in BLOCKS.values())
WEIGHT = np.concatenate([np.full(len(parts), w) for parts, w in BLOCKS.values()])
EDGES = (16, 32, 48, 80, 160)

# Shares that the profiles start from; a block that is not named starts as in running prose.
PROSE = {
    "words": (0.4, 0.55, 0.01, 0.04, 0.0), "classes": (0.775, 0.025, 0.005, 0.165, 0.025, 0.005, 0.0, 0.0), "letters": (8.2, 1.4, 2.9, 4.3, 14.9, 1.3, 1.9, 2.9, 7.6, 0.4, 1.0, 4.8, 2.5, 8.2, 6.0, 2.1, 0.5, 6.9, 6.5, 7.2, 4.0, 1.4, 1.2, 0.2, 0.6, 0.8, 1.0),
    "runs": (0.95, 0.05), "ranks": (0.3, 0.3, 0.4), "lengths": (0.0, 0.0, 0.02, 0.03, 0.15, 0.8), "ends": (0.85, 0.15), "columns": (0.0, 1.0),
}
EVEN = (1.0,) * 26 + (0.5,)
STARTS = {
    ("prose", "paragraphs"): {},
    ("prose", "wrapped"): {"lengths": (0.0, 0.05, 0.1, 0.85, 0.0, 0.0), "ends": (0.4, 0.6)},
    ("prose", "sentences"): {"lengths": (0.0, 0.02, 0.1, 0.38, 0.4, 0.1)},
    ("prose", "misread"): {"classes": (0.71, 0.025, 0.005, 0.165, 0.025, 0.02, 0.0, 0.05)},
    ("list", "words"): {"lengths": (0.6, 0.35, 0.05, 0.0, 0.0, 0.0), "ends": (0.05, 0.95), "words": (0.1, 0.75, 0.1, 0.05, 0.0), "ranks": (0.2, 0.3, 0.5)},
    ("list", "phrases"): {"lengths": (0.0, 0.7, 0.3, 0.0, 0.0, 0.0), "ends": (0.05, 0.95), "words": (0.5, 0.5, 0.0, 0.0, 0.0)},
    ("table", "numbers"): {"columns": (0.98, 0.02), "lengths": (0.0, 0.2, 0.4, 0.4, 0.0, 0.0), "ends": (0.05, 0.95), "words": (0.05, 0.35, 0.5, 0.1, 0.0), "classes": (0.3, 0.1, 0.3, 0.2, 0.05, 0.05, 0.0, 0.0)},
    ("table", "phrases"): {"columns": (0.98, 0.02), "lengths": (0.0, 0.0, 0.2, 0.7, 0.1, 0.0), "ends": (0.05, 0.95), "words": (0.3, 0.5, 0.15, 0.05, 0.0)},
    ("junk", "code"): {"words": (0.05, 0.25, 0.05, 0.5, 0.15), "classes": (0.6, 0.04, 0.07, 0.05, 0.12, 0.12, 0.0, 0.0), "ends": (0.6, 0.4), "lengths": (0.0, 0.1, 0.2, 0.4, 0.2, 0.1)},
    ("junk", "base64"): {"words": (0.0, 0.02, 0.0, 0.03, 0.95), "classes": (0.41, 0.40, 0.16, 0.0, 0.0, 0.03, 0.0, 0.0), "letters": EVEN, "ends": (0.0, 1.0), "lengths": (0.0, 0.0, 0.05, 0.75, 0.2, 0.0)},
    ("junk", "escapes"): {"words": (0.0, 0.02, 0.05, 0.13, 0.8), "classes": (0.24, 0.06, 0.45, 0.0, 0.0, 0.25, 0.0, 0.0), "letters": EVEN, "ends": (0.05, 0.95), "lengths": (0.0, 0.0, 0.05, 0.5, 0.3, 0.15)},
    ("junk", "noise"): {"words": (0.0, 0.03, 0.0, 0.47, 0.5), "classes": (0.28, 0.28, 0.11, 0.0, 0.10, 0.23, 0.0, 0.0), "letters": EVEN, "ends": (0.2, 0.8), "lengths": (0.0, 0.05, 0.15, 0.5, 0.2, 0.1)},
    ("junk", "symbols"): {"words": (0.0, 0.02, 0.03, 0.55, 0.4), "classes": (0.05, 0.02, 0.05, 0.1, 0.3, 0.48, 0.0, 0.0), "ends": (0.4, 0.6)},
    ("junk", "bytes"): {"words": (0.0, 0.5, 0.0, 0.5, 0.0), "classes": (0.02, 0.02, 0.0, 0.1, 0.02, 0.02, 0.12, 0.7), "letters": (0.0,) * 26 + (1.0,)},
    ("junk", "lost bytes"): {"words": (0.0, 1.0, 0.0, 0.0, 0.0), "classes": (0.68, 0.0, 0.0, 0.15, 0.02, 0.0, 0.15, 0.0), "letters": (0.0,) * 26 + (1.0,)},
    ("junk", "letters"): {"words": (0.01, 0.95, 0.0, 0.04, 0.0), "letters": EVEN, "runs": (1.0, 0.0), "ranks": (0.08, 0.2, 0.72)},
    ("junk", "again"): {"runs": (0.1, 0.9), "ranks": (0.45, 0.45, 0.1)},
    ("junk", "few words"): {"runs": (0.4, 0.6), "ranks": (0.9, 0.1, 0.0), "words": (0.05, 0.95, 0.0, 0.0, 0.0), "classes": (0.85, 0.0, 0.0, 0.15, 0.0, 0.0, 0.0, 0.0), "ends": (0.1, 0.9)},
}


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two distributions (0 equal, 1 disjoint)."""
    p, q = p / max(p.sum(), 1e-12), q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return (part(p) + part(q)) / 2


def _entropy(p: np.ndarray) -> np.ndarray:
    return -p * np.log2(np.maximum(p, 1e-300))


def _normed(p: np.ndarray) -> np.ndarray:
    """Each block of a row of counts as shares."""
    p = np.atleast_2d(np.asarray(p, float)).copy()
    for a, b in SPAN.values():
        total = p[:, a:b].sum(axis=1, keepdims=True)
        p[:, a:b] = np.divide(p[:, a:b], total, out=np.zeros_like(p[:, a:b]), where=total > 0)
    return p


class Profiles:
    """Distributions of every kind of text, with the common words and the boilerplate that texts are read by."""

    def __init__(self, common: dict[str, set[str]], boilerplate: Sequence[str] = (), table: np.ndarray | None = None, names: list[tuple[str, str]] | None = None) -> None:
        self.common = {lang: frozenset(w.lower() for w in words) for lang, words in common.items()}
        self.boilerplate = frozenset(boilerplate)
        # A common word misread in its accented letters is known too.
        self.words = {}
        for lang, words in self.common.items():
            spelt = set(words)
            for w in words:
                if not w.isascii():
                    spelt.update((w.encode().decode("latin-1"), w.encode().decode("cp1252", "replace"), re.sub(r"[^\x00-\x7f]", "�", w)))
            self.words[lang] = frozenset(spelt)
        self.any = frozenset().union(*self.words.values()) if self.words else frozenset()
        self.names = names or list(STARTS)
        if table is None:
            table = _normed(np.array([np.concatenate([np.asarray((PROSE | start)[block], float) for block in BLOCKS]) for start in STARTS.values()]))
        self.table = table
        self._half = _entropy(table) / 2

    def distances(self, seen: np.ndarray) -> np.ndarray:
        """Summed divergence of a row of shares, or of each of several, to every profile; blocks that a row leaves empty do not count."""
        p = _normed(seen)
        known = np.concatenate([np.repeat(p[:, a:b].sum(axis=1, keepdims=True) > 0, b - a, axis=1) for a, b in SPAN.values()], axis=1)
        out = np.empty((len(p), len(self.table)))
        for i in range(0, len(p), ROWS):
            q, counted = p[i:i + ROWS, None], (WEIGHT * known[i:i + ROWS])[:, None]
            gain = _entropy((self.table + q) / 2) - self._half - _entropy(q) / 2
            out[i:i + ROWS] = (gain * counted).sum(axis=2)
        return out if np.ndim(seen) == 2 else out[0]

    def tally(self, seen: np.ndarray) -> np.ndarray:
        """For every profile, over the rows nearest to it: sums of shares in ``PART``, rows that fill each block, and rows."""
        p, at = _normed(seen), self.distances(seen).argmin(axis=1)
        filled = np.stack([p[:, a:b].sum(axis=1) > 0 for a, b in SPAN.values()], axis=1)
        cells = np.concatenate([np.rint(p / PART).astype(np.int64), filled, np.ones((len(p), 1), np.int64)], axis=1)
        return np.stack([cells[at == i].sum(axis=0) for i in range(len(self.table))])

    def moved(self, tallied: np.ndarray, least: int = 5) -> Profiles:
        """Profiles at the mean of the tallied rows; those with fewer than ``least`` rows stay."""
        table = self.table.copy()
        for i, row in enumerate(tallied):
            for j, (a, b) in enumerate(SPAN.values()):
                if row[-1] >= least and row[WIDTH + j]:
                    table[i, a:b] = row[a:b].astype(float) * (PART / float(row[WIDTH + j]))
        return Profiles(self.common, self.boilerplate, _normed(table), self.names)

    def fitted(self, rows: np.ndarray, rounds: int = ROUNDS) -> Profiles:
        """Profiles moved to the mean of the rows nearest to them, round by round."""
        now = self
        for _ in range(rounds):
            now = now.moved(now.tally(np.asarray(rows).reshape(-1, WIDTH)))
        return now

    def language(self, words: list[str]) -> tuple[str, float]:
        """Language whose common words are most frequent, with their share."""
        if not words:
            return "", 0.0
        counts = Counter(words)
        best, lang = 0, ""
        for name, common in self.words.items():
            n = sum(c for w, c in counts.items() if w in common)
            if n > best:
                best, lang = n, name
        return lang, best / len(words)


def classes(text: str) -> np.ndarray:
    """Counts of the classes of characters in ``BLOCKS``."""
    out = np.zeros(8)
    for c, n in Counter(text).items():
        o = ord(c)
        if c == "�" or 0x80 <= o < 0xA0 or o < 32 and c not in "\t\n\r":
            out[6] += n
        elif 0xA0 <= o <= 0xFF or c in CP1252 and c not in "…“”’‘–—":
            out[7] += n
        elif c.isalpha():
            out[1 if c.isupper() else 0] += n
        elif c.isdigit():
            out[2] += n
        elif c.isspace():
            out[3] += n
        elif c in ".,!?:;'\"’“”„«»()…–-":
            out[4] += n
        else:
            out[5] += n
    return out


def units(line: str, host: str | None) -> list[str]:
    """What a line repeats: its short parts between marks if it has only such, else the line; digits and the host are masked."""
    text = line.strip().lower()
    if host:
        text = text.replace(host.lower(), "@")
    text = DIGIT.sub("0", text)
    parts = [p for p in SPLIT.split(text) if p]
    return [p for p in parts if any(c.isalpha() or c == "@" for c in p)] if parts and all(len(p) <= 20 for p in parts) else [text]


def split_lines(text: str) -> list[str]:
    return [ln for ln in LINES.split(text) if ln.strip()]


def main_lines(lines: list[str], host: str | None, boilerplate: frozenset[str]) -> list[str]:
    """Lines without those at the edges that consist of boilerplate, and without whole sentences of it anywhere.

    At the edges a line goes if half of its parts are boilerplate; one unknown
    line between two such lines goes with them.
    """
    if not boilerplate:
        return lines

    def known(line: str) -> bool:
        parts = units(line, host)
        return bool(parts) and 2 * sum(p in boilerplate for p in parts) >= len(parts)

    begin, end = 0, len(lines)
    while begin < end and (known(lines[begin]) or begin and begin + 1 < end and len(lines[begin]) <= 20 and known(lines[begin + 1])):
        begin += 1
    while end > begin and known(lines[end - 1]):
        end -= 1
    return [ln for ln in lines[begin:end] if len(ln) < 30 or not boilerplate.issuperset(units(ln, host)[:1] or [""])]


def divided(lines: list[str]) -> tuple[int, np.ndarray]:
    """Number of columns, and which lines are divided into them, for the mark that divides most.

    Cells are short on average; with blanks as the mark they are padded, so
    empty ones merge and any number of at least two counts.
    """
    best_number, best_hit, best_mass = 0, np.zeros(len(lines), bool), 0
    size = np.array([len(ln) for ln in lines])
    for mark in COLUMN_MARKS:
        if sum(mark in ln for ln in lines) < 2:
            continue
        cells = []
        for ln in lines:
            if mark not in ln:
                cells.append(2 if mark == "  " and ln[:8] == " " * 8 else 0)
                continue
            held = len(ln)
            if mark == "  ":
                parts = [p for p in re.split(r"\s{2,}", ln.strip()) if p]
                n, held = len(parts), sum(map(len, parts))
                n = 2 if n == 1 and ln[:8] == " " * 8 else n
            else:
                text = ln.strip() if mark == "|" else ln.strip(" ").rstrip(";,") if mark in (";", ",") else ln
                n = text.count(mark) + 1
            cells.append(n if n >= (3 if mark == "," else 2) and held <= 30 * n else 0)
        cells = np.array(cells)
        numbers = np.unique(cells[cells > 0])
        if not len(numbers):
            continue
        number = max(numbers, key=lambda n: (size[cells == n].sum(), -n))
        hit = cells >= 2 if mark == "  " else cells == number
        if hit.sum() >= max(2, min(3, len(lines))) and size[hit].sum() > best_mass:
            best_number, best_hit, best_mass = int(number), hit, int(size[hit].sum())
    return best_number, best_hit


def features(lines: list[str], profiles: Profiles) -> dict:
    """Counts of one text for every block of ``BLOCKS``, and what the statistics take from it."""
    body = "\n".join(lines)
    words = [w.lower() for w in WORD.findall(body)]
    language, common = profiles.language(words)
    known = profiles.words.get(language, frozenset())
    counts = classes(body)
    out = np.zeros(WIDTH)
    put = lambda block, values: out.__setitem__(slice(*SPAN[block]), values)
    put("classes", counts)
    tally = Counter(words)
    letters = Counter(body.lower())
    latin = np.array([letters.get(c, 0) for c in "abcdefghijklmnopqrstuvwxyz"], float)
    # Common words and letters tell nothing about scripts that they do not belong to.
    spoken = sum(n for c, n in letters.items() if c.isalpha())
    readable = latin.sum() >= 0.5 * spoken or counts[6] + counts[7] > 0.3 * len(body)
    if readable:
        token = [0.0] * 5
        long = sum(len(t) for t in body.split() if len(t) >= UNBROKEN and t.isascii() and "://" not in t)
        numbers = sum(len(t) for t in body.split() if NUMERIC.fullmatch(t))
        for w, n in tally.items():
            token[0 if w in known else 1] += n * len(w)
        total = sum(len(t) for t in body.split())
        token[2], token[4] = numbers, long
        token[3] = max(0.0, total - token[0] - token[1] - numbers)
        if long:
            scale = max(0.0, 1 - long / total)
            token[:4] = [v * scale for v in token[:4]]
        put("words", token)
        put("letters", [*latin, spoken - latin.sum()])
    n = len(words)
    runs = len(set(zip(words, words[1:], words[2:], words[3:]))) / (n - 3) if n > 3 else 1.0
    if n >= FEW:
        put("runs", (runs, 1 - runs))
        ranked = sorted(tally.values(), reverse=True)
        put("ranks", (sum(ranked[:4]), sum(ranked[4:16]), sum(ranked[16:])))
    size = np.array([len(ln.strip()) for ln in lines], float)
    put("lengths", np.bincount(np.searchsorted(EDGES, size, side="right"), size, minlength=6)[:6] if len(lines) else np.zeros(6))
    ended = sum(bool(SENTENCE.search(ln)) for ln in lines)
    put("ends", (ended, len(lines) - ended))
    number, hit = divided(lines)
    put("columns", (size[hit].sum(), size[~hit].sum()) if len(lines) else (0, 0))
    return {"shares": out, "words": words, "language": language, "common": common, "classes": counts, "body": body, "lines": lines, "ended": ended, "runs": runs, "columns": number}


def read_text(text: str, profiles: Profiles, host: str | None = None) -> dict:
    """Features of one text, and whether nothing of it is left."""
    lines = split_lines(text)
    kept = main_lines(lines, host, profiles.boilerplate)
    got = features(kept or lines, profiles)
    return got | {"empty": not got["body"].strip() or not kept}


KINDS = ("prose", "list", "table", "junk")


def kind_of(away: np.ndarray, empty: bool, profiles: Profiles) -> dict:
    """Distance to the nearest profile of each kind, and the kind, from the distances of one text to every profile."""
    far = {kind: min(d for (k, _), d in zip(profiles.names, away) if k == kind) for kind in KINDS}
    at = int(np.argmin(away))
    return {"kind": "empty" if empty else profiles.names[at][0], "profile": None if empty else profiles.names[at][1], "far": far}


def describe(text: str, profiles: Profiles, host: str | None = None) -> dict:
    """Features of one text, its distance to the nearest profile of each kind, and its kind."""
    got = read_text(text, profiles, host)
    return got | kind_of(profiles.distances(got["shares"]), got["empty"], profiles)


COMMON_BOUND = 100_000


def read_common(commonwords: DataFrame) -> dict[str, set[str]]:
    """Common words by language; the table may hold ``COMMON_BOUND`` rows at most."""
    rows = commonwords.where("lang is not null and word is not null").limit(COMMON_BOUND + 1).collect()
    if len(rows) > COMMON_BOUND:
        raise ValueError(f"more than {COMMON_BOUND} common words")
    common: dict[str, set[str]] = {}
    for row in rows:
        common.setdefault(row["lang"], set()).add(row["word"])
    return common


def _tongue(lang: pd.Series) -> pd.Series:
    return lang.fillna("").str.strip().str.lower().str[:2]


def boilerplate_units(documents: DataFrame, share: float = REPEATED, least: int = LEAST) -> list[str]:
    """What at least ``share`` of a language's documents repeat at their edges, counted over all documents.

    The count less twice its deviation must reach the share, so that chance in a
    small language does not do. A document has at most some dozen units, so that
    no more than that many times 1 / ``share`` can reach it, in each language.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["tongue", "unit", "n"])
            counts.clear()
            return frame

        for batch in batches:
            for text, tongue, host in zip(batch["text"], _tongue(batch["lang"]), batch["host"]):
                lines = split_lines(text)
                edge = lines[:TOP] + lines[max(TOP, len(lines) - BOTTOM):]
                seen = {u for ln in edge if len(ln) <= 200 for u in units(ln, host if isinstance(host, str) else None)}
                counts.update((tongue, u) for u in seen)
                counts[tongue, ""] += 1
            if len(counts) > 200_000:
                yield out()
        if counts:
            yield out()

    texts = documents.where("text is not null").select("text", F.col("lang").cast("string").alias("lang"), F.col("host").cast("string").alias("host"))
    counted = checkpoint(texts.mapInPandas(run, "tongue string, unit string, n bigint").groupBy("tongue", "unit").agg(F.sum("n").alias("n")))
    whole = counted.where("unit = ''").select("tongue", F.col("n").alias("of"))
    often = counted.where("unit <> ''").join(F.broadcast(whole.where(F.col("of") >= least)), "tongue").where(F.col("n") - 2 * F.sqrt("n") >= share * F.col("of"))
    return sorted(r["unit"] for r in often.select("unit").distinct().collect())


def learned_common(documents: DataFrame, boilerplate: frozenset[str], known: set[str], share: float = COMMON, least: int = LEAST) -> dict[str, set[str]]:
    """Words that at least ``share`` of a language's documents hold, counted over all documents, for languages that are not ``known``.

    No more words than a document holds on average times 1 / ``share`` can
    reach it, in each language.
    """

    def tongues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tongue": _tongue(batch["lang"]), "n": batch["n"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["tongue", "word", "n"])
            counts.clear()
            return frame

        for batch in batches:
            for text, tongue, host in zip(batch["text"], _tongue(batch["lang"]), batch["host"]):
                if tongue in of:
                    kept = main_lines(split_lines(text), host if isinstance(host, str) else None, boilerplate)
                    counts.update((tongue, w) for w in {w.lower() for ln in kept for w in WORD.findall(ln)})
                    if len(counts) > 200_000:
                        yield out()
        if counts:
            yield out()

    texts = documents.where("text is not null").select("text", F.col("lang").cast("string").alias("lang"), F.col("host").cast("string").alias("host"))
    counted = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).mapInPandas(tongues, "tongue string, n bigint").groupBy("tongue").agg(F.sum("n").alias("n"))
    of = {r["tongue"]: r["n"] for r in counted.where(F.col("n") >= least).collect() if r["tongue"] and r["tongue"] not in known}
    if not of:
        return {}
    whole = documents.sparkSession.createDataFrame(list(of.items()), "tongue string, of bigint")
    words = texts.mapInPandas(run, "tongue string, word string, n bigint").groupBy("tongue", "word").agg(F.sum("n").alias("n"))
    learned: dict[str, set[str]] = {}
    for row in words.join(F.broadcast(whole), "tongue").where(F.col("n") >= share * F.col("of")).collect():
        learned.setdefault(row["tongue"], set()).add(row["word"])
    # Of languages with equal counts in a text the first is taken.
    return dict(sorted(learned.items()))


def start_profiles(documents: DataFrame, commonwords: DataFrame) -> Profiles:
    """Profiles before any is fitted, with the boilerplate and the common words of all documents."""
    common = read_common(commonwords)
    boilerplate = frozenset(boilerplate_units(documents))
    return Profiles(common | learned_common(documents, boilerplate, set(common)), boilerplate)


MEASURES = (
    "language string, n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines int, lines_punctuated double, "
    "common_share double, repetition double, columns int"
)


def _measures(d: dict) -> tuple:
    lines, words, body = d["lines"], d["words"], d["body"]
    counts, n = d["classes"], len(body)
    return (
        d["language"] or None, len(words), sum(map(len, words)) / len(words) if words else None, counts[5:].sum() / n if n else None, counts[2] / n if n else None,
        len(lines), d["ended"] / len(lines) if lines else None, d["common"], d["runs"], d["columns"],
    )


def read_texts(documents: DataFrame, profiles: Profiles, measures: bool = True) -> DataFrame:
    """Each document's doc_id, whether nothing of it is left, counts of the blocks, and its ``measures`` if asked for; nulls for a null text."""
    schema = "doc_id bigint, empty boolean, shares array<double>" + (", " + MEASURES if measures else "")
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = [(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]

    def row(text: str | None, host: str | None) -> tuple:
        if text is None:
            return (None,) * (len(fields) - 1)
        got = read_text(text, profiles, host)
        return got["empty"], got["shares"], *(_measures(got) if measures else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t, h) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = zip(*rows) if rows else [()] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields[1:]))], [name for name, _ in fields])

    return documents.select("doc_id", "text", F.col("host").cast("string").alias("host")).mapInArrow(run, schema)


def _rows(shares: pa.Array) -> np.ndarray:
    return shares.flatten().to_numpy().reshape(-1, WIDTH)


def fit_read(texts: DataFrame, start: Profiles, rounds: int = ROUNDS) -> Profiles:
    """Profiles fitted to all rows of ``read_texts`` that are not empty; a round sums on the executors, and a few sums a profile reach the driver."""
    rows, now = texts.where("not empty").select("shares"), start
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Profiles = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = now.tally(_rows(batch.column(0)))
                at, cell = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(cell, pa.int32()), pa.array(sums[at, cell])], ["profile", "cell", "n"])

        tallied = np.zeros((len(now.table), WIDTH + len(BLOCKS) + 1), object)
        for row in rows.mapInArrow(run, "profile int, cell int, n bigint").groupBy("profile", "cell").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n")).collect():
            tallied[row["profile"], row["cell"]] = int(row["n"])
        now = now.moved(tallied)
    return now


def fit_profiles(documents: DataFrame, commonwords: DataFrame) -> Profiles:
    """Boilerplate, common words and profiles, each from all documents."""
    start = start_profiles(documents, commonwords)
    texts = checkpoint(read_texts(documents, start, measures=False))
    fit = fit_read(texts, start)
    drop_checkpoint(texts)
    return fit


def _read_and_fit(documents: DataFrame, commonwords: DataFrame, profiles: Profiles | None, measures: bool) -> tuple[DataFrame, Profiles]:
    if profiles:
        return read_texts(documents, profiles, measures), profiles
    # What a text is read by does not change with the fit, so each is read once for both.
    start = start_profiles(documents, commonwords)
    texts = checkpoint(read_texts(documents, start, measures))
    return texts, fit_read(texts, start)


STATISTICS = f"doc_id bigint, kind string, profile string, {MEASURES}, prose_distance double, list_distance double, table_distance double, junk_distance double"


def text_statistics(documents: DataFrame, commonwords: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """One row of statistics for every row of documents, of the text without boilerplate at its edges.

    ``kind`` is prose, list, table, junk or empty, ``profile`` the nearest
    profile of that kind, and ``..._distance`` the summed divergence to the
    nearest profile of each kind. A null text gives nulls throughout, an empty
    or blank one, or one of boilerplate only, gives empty. Repeated rows each
    come out; columns other than doc_id, text, lang and host are not read.
    """
    texts, fit = _read_and_fit(documents, commonwords, profiles, True)
    names = [part.split()[0] for part in STATISTICS.split(", ")]
    ends = pa.schema([("kind", pa.string()), ("profile", pa.string()), *((f"{kind}_distance", pa.float64()) for kind in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = iter(fit.distances(_rows(batch.column("shares"))))
            found = [None if empty is None else kind_of(next(away), empty, fit) for empty in batch.column("empty").to_pylist()]
            ended = [{"kind": d["kind"], "profile": d["profile"]} | {f"{k}_distance": float(v) for k, v in d["far"].items() if d["kind"] != "empty"} if d else {} for d in found]
            added = pa.RecordBatch.from_pylist(ended, ends)
            yield pa.RecordBatch.from_arrays([batch.column(n) if n in batch.schema.names else added.column(n) for n in names], names)

    return texts.mapInArrow(run, STATISTICS)


def structured_texts(documents: DataFrame, commonwords: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Documents that are nearest to a profile of a list, a table or junk: doc_id, kind."""
    texts, fit = _read_and_fit(documents, commonwords, profiles, False)
    kinds = np.array([kind for kind, _ in fit.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = fit.distances(_rows(batch.column(1))).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds[at])], ["doc_id", "kind"])

    return texts.where("not empty").select("doc_id", "shares").mapInArrow(run, "doc_id bigint, kind string").where(F.col("kind").isin("list", "table", "junk"))


def text_counts(documents: DataFrame, commonwords: DataFrame) -> DataFrame:
    """Basic counts of the whole texts as column expressions; null texts give nulls.

    Words are runs of letters, symbols are characters other than letters, digits
    and white space; a line counts unless it is blank, and ends in punctuation
    if its last character but blanks is one of . ! ? : ; and the ellipsis.
    ``common_share`` is the share of words that are common ones of any language.
    """
    # The list of common words has a bound and is part of the expression.
    common = sorted({w.lower() for words in read_common(commonwords).values() for w in words})
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    known_words = F.filter(words, lambda w: F.lower(w).isin(common)) if common else F.array()
    lines = F.regexp_count("text", F.lit(r"[^\r\n]*[^\s][^\r\n]*"))
    punctuated = F.regexp_count("text", F.lit(r"[^\r\n]*[.!?:;…][ \t]*(\r|\n|$)"))
    n = F.size(words)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    symbols = F.length(F.regexp_replace("text", r"[\p{L}\p{Nd}\s]+", ""))
    known = F.col("text").isNotNull()
    ratio = lambda a, b: F.when(known, F.round(F.try_divide(a.cast("double"), b.cast("double")), 6))
    return documents.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars_text"), F.when(known, n).cast("bigint").alias("n_words"), ratio(letters, n).alias("mean_word_length"),
        ratio(symbols, F.length("text")).alias("symbol_ratio"), F.when(known, lines).cast("bigint").alias("n_lines"), ratio(punctuated, lines).alias("lines_punctuated"), ratio(F.size(known_words), n).alias("common_share"),
    )
