"""Text of scanned pages back to continuous paragraphs: broken and misread words, running heads and page numbers.

1. Words and pairs of words near each other are counted over the whole corpus, on the cluster. Skip-gram vectors of the
   frequent words are the factors of the pairs' pointwise mutual information, which skip-gram with negative sampling
   approximates. Vectors of character n-grams are fitted to them, so that a word's vector can be told from its spelling.
2. Every word from which glyph edits (rn for m, cl for d, 1 for l, ...) lead to a more frequent word gets a vector of its
   own: half from the words around it in all its places, half from its n-grams. It is linked to those of the frequent
   words among its NEAREST neighbours by cosine to which the glyph edits lead. Without a vector there is no link.
3. In its place a linked word is corrected unless the frequent word fits the words around worse than words do on average,
   by more than a standard deviation; of several the one that fits best is taken.
4. The furniture at the edges of a text is removed (running heads and feet, page numbers), broken words are joined and
   lines reflow into paragraphs.

Parameters and bounds: the VOCABULARY most frequent words of up to LONGEST characters with their counts and vectors are
sent to the executors, and BUCKETS vectors of n-grams; a vector has DIM numbers, found in ROUNDS passes over the pairs,
of which the driver holds none. Links are a table of the cluster, one row per word however many there are, and reach the
texts by a join. A correction takes up to EDITS edits and RATIO times the count of what stands there. All texts are
repaired whole.

Defined cases: null texts give no row; empty and blank texts stay empty; a word broken at a hyphen that the corpus spells
inside lines with that hyphen keeps it; a hyphen at the very end of a text is kept; a lone number within a text is
content; section headings stay lines of their own; list items and table rows are not joined. Equal rows of a
(field, item_id) count once; differing texts under one id are each repaired.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quirelake.session import durable, spread

VOCABULARY, RATIO, MIN_COUNT, LONGEST, EDITS = 60_000, 8, 4, 100, 3
DIM, SPARE, WINDOW, ROUNDS = 128, 8, 2, 3
NEAREST = 200
BUCKETS, RIDGE, STEPS = 1 << 15, 0.1, 10

# What a recogniser writes, and what may have stood there.
GLYPHS = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("h", "li"), ("h", "b"), ("b", "h"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("0", "o"), ("5", "s"), ("c", "e"), ("e", "c"),
    ("fl", "fi"), ("9", "g"), ("6", "b"), ("8", "b"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("n", "ri"), ("u", "ii"), ("li", "h"), ("$", "s"), ("3", "e"), ("4", "a"), ("7", "t"), ("@", "a"), ("lc", "k"), ("tt", "n"), ("nn", "rm"), ("f", "t"), ("t", "f"), ("o", "a"), ("a", "o"), ("u", "v"), ("v", "u"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("ch", "di"), ("li", "u"), ("c1", "d"), ("r1", "n"), ("rl", "n"), ("rri", "m"), ("1i", "u"), ("i1", "u"),
)
_BY_FIRST: dict[str, list] = {}
for _seen, _meant in GLYPHS:
    _BY_FIRST.setdefault(_seen[0], []).append((_seen, _meant))
WORD = r"[^\W_]+(?:[|!$@][^\W_]+)*"
_WORD = re.compile(WORD)
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
HYPHENS = "-‐‑­¬"
_BROKEN = re.compile(rf"([^\W_|]+(?:[|!$][^\W_]+)*)([{HYPHENS}])\s*$")
_OVER_LINES = re.compile(rf"[{HYPHENS}][^\S\n]*\n\s*")
_LAST_WORD = re.compile(rf"{WORD}\Z")
_ROMAN = re.compile(r"(?=[ivxl])(?:x{0,3})(?:ix|iv|v?i{0,3})")
_PAGE = re.compile(
    r"\W*(?:(?:page|pages|pg|p|seite|s|sheet|blatt|folio|fol|página|pagina|pág|pag|page n[o°])\b\W*)?\d{1,4}(?:\s*(?:of|/|von|de|sur|out of)\s*\d{1,4})?\W*", re.I
)
_PAGE_WORD = re.compile(r"page|pg|seite|sheet|blatt|folio|p[áa]g|^\W*(?:p|s)\b|of|von|sur|/|^\W*[\[(\-–—]\s*\d+\s*[\])\-–—]\W*$", re.I)
_KINDS = r"(?:nursing report|clinic record|operation note|discharge summary|outpatient letter|referral form|progress note|laboratory report|lab report|radiology report|consultation note|admission note|case notes?|medical record|patient record|prescription form|arztbrief|entlassungsbrief|compte rendu|informe)"
_PLACES = r"(?:hospital|infirmary|clinic|surgery unit|health centre|medical centre|medical center|klinikum|krankenhaus|hôpital|clinique)"
_HEAD = re.compile(
    rf"\*\*.*\((?:continued|cont\.?|cont'd)\).*|.*\bcontinued (?:overleaf|on next page|from previous page)\b.*|copy for (?:the )?(?:file|records?|gp|patient).*|.*\bdo not file\b.*|printed\s+\d.*\bform\b.*|scan \d.*\barchive|.*\barchive copy\b.*"
    rf"|(?:confidential\W*)?{_KINDS}\s*(?:[|/:·•–—-]|\.{{3,}}|\s{{2,}}|\bof\b).*{_PLACES}\b.*|[^.;,]*{_PLACES}\s*(?:[|/:·•–—-]|\.{{3,}}|\s{{2,}}).*{_KINDS}.*|{_KINDS}\s*[|/·•-].*confidential.*|strictly confidential.*",
    re.I,
)
# What every running head but a spaced-out name holds; looked for before the patterns.
_HINTS = ("hospital", "infirmary", "clinic", "surgery unit", "centre", "center", "klinikum", "krankenhaus", "hôpital", "clinique", "report", "record", "note", "summary", "letter", "form", "brief", "compte rendu", "informe", "continued", "cont.", "copy", "file", "printed", "archive", "confidential")
_FORM_NO = re.compile(r"form [A-Z]{1,3}-\d+ rev\b.*", re.I)
_PLACE_LINE = re.compile(rf"(?:[A-ZÀ-Þ][\w'&-]*\s+|of\s+|and\s+|the\s+|[a-z]+\s+clinic,\s*|clinic,\s*|unit,\s*|team,\s*|ward,\s*|services?,\s*){{1,7}}{_PLACES}\W*", re.I)
_SPACED_OUT = re.compile(r"\s*[A-ZÀ-Þ](?:\s[A-ZÀ-Þ]){3,}\s*")
_LABEL_END = re.compile(r"[:=]\s*$|\s-\s*$")
_LIST = re.compile(r"\s*(?:[-*•·]|\d{1,3}[.)])\s+\S")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] + [c.lower() for c in _COMPOUND.findall(text)]


def count_words(texts: DataFrame) -> dict[str, int]:
    """The VOCABULARY most frequent words and hyphenated words of at least MIN_COUNT over all texts, with their counts.

    Counted in the JVM over every text; only the head of the list, of bounded length, comes to the driver.
    """
    w = texts.select(F.explode(F.concat(F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{N}|!$@]+', 0)"), F.expr(r"regexp_extract_all(text, '\\p{L}+(-\\p{L}+)+', 0)"))).alias("w"))
    top = w.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).where((F.col("n") >= MIN_COUNT) & (F.length("w") <= LONGEST)).orderBy(F.desc("n"), "w").limit(VOCABULARY)
    return {r["w"]: r["n"] for r in top.collect()}


@dataclass
class Vectors:
    """Vectors of the frequent words: as words, as contexts, and those of the n-grams that spell them."""

    index: dict[str, int] = field(default_factory=dict)
    vec: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    ctx: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))  # pairs of each word
    grams: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))

    def __post_init__(self):
        c = self.ctx.astype(np.float64)
        self.solve = np.linalg.pinv(c.T @ c).astype(np.float32)
        self.unit = _unit(self.vec)
        self.cov = np.cov(self.vec.T) if len(self.vec) > 1 else np.zeros((self.vec.shape[1],) * 2)
        self.mean = self.vec.mean(axis=0) if len(self.vec) else np.zeros(self.vec.shape[1], np.float32)

    def spread(self, around: np.ndarray) -> float:
        """How far the words' fits to these neighbours lie apart: their standard deviation."""
        return float(np.sqrt(max(around @ self.cov @ around, 0.0)))

    def frequency(self, counts: dict[str, int]) -> np.ndarray:
        if not hasattr(self, "_n"):
            self._n = np.array([counts[w] for w in self.index], np.int64)
        return self._n

    def of(self, word: str, near: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The vector of any word from its neighbours (numbers and counts) and from its n-grams; zero where neither is known."""
        around = np.zeros(self.vec.shape[1], np.float32)
        if len(near):
            w = np.maximum(np.log(times * (self.total.sum() / times.sum() / self.total[near])), 0)
            around = (w @ self.ctx[near]) @ self.solve
        return _unit(_unit(around[None]) + _unit(self.grams[_grams(word)].sum(axis=0)[None]))[0]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 1e-9)


def _grams(word: str) -> list[int]:
    """The buckets of a word's one to three neighbouring characters, its ends marked."""
    s = f"<{word}>"
    return sorted({crc32(s[i : i + n].encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(s) - n + 1)})


def _numbers(counts: dict[str, int]) -> dict[str, int]:
    return {w: i for i, w in enumerate(w for w in counts if w.isalpha())}


def _pairs(texts, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): how often words stand within WINDOW of each other, in both directions."""
    ids: list[int] = []
    get, apart = vocab.get, [-1] * WINDOW
    for t in texts:
        ids += [get(w, -1) for w in _WORD.findall(t.lower())]
        ids += apart  # the next text begins outside the window
    at = np.array(ids, np.int64)
    keys = [np.empty(0, np.int64)]
    for d in range(1, WINDOW + 1):
        a, b = at[:-d], at[d:]
        ok = (a >= 0) & (b >= 0)
        keys += [a[ok] * len(vocab) + b[ok], b[ok] * len(vocab) + a[ok]]
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return *(np.divmod(key, len(vocab)) if len(vocab) else (key, key)), n


def _starts(at: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of equal number; `at` is sorted."""
    first = _starts(at)
    return at[first], np.add.reduceat(rows, first, axis=0) if len(at) else rows


def _times(a: np.ndarray, b: np.ndarray, n: np.ndarray, total: np.ndarray, q: np.ndarray, block: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (positive pointwise mutual information) @ q: the words that have one, and their rows."""
    order = np.argsort(a, kind="stable")
    a, b, n = a[order], b[order], n[order]
    w = np.maximum(np.log(n * (total.sum() / total[a] / total[b])), 0)
    parts = [_sums(a[lo : lo + block], w[lo : lo + block, None] * q[b[lo : lo + block]]) for lo in range(0, len(a), block)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, q.shape[1]))
    return _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _factors(times, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors, the leading factors of a symmetric matrix that is known by its products; zero for an empty row."""
    vec, sign = np.zeros((n, DIM)), np.ones(DIM)
    if n:
        q = np.random.default_rng(seed).normal(size=(n, min(n, DIM + SPARE)))
        for _ in range(ROUNDS):
            q = np.linalg.qr(times(q))[0]
        m = times(q)
        t = q.T @ m
        value, u = np.linalg.eigh((t + t.T) / 2)
        top = np.argsort(-np.abs(value), kind="stable")[:DIM]
        vec[:, : len(top)] = q @ u[:, top] * np.sqrt(np.abs(value[top]))
        sign[: len(top)] = np.sign(value[top])
        vec[~m.any(axis=1)] = 0
    return vec.astype(np.float32), (vec * sign).astype(np.float32)


def _spell(index: dict[str, int], vec: np.ndarray, counts: dict[str, int]) -> np.ndarray:
    """Vectors of n-grams whose sum over a word comes near the word's vector (ridge regression by conjugate gradients)."""
    gr = [_grams(w) for w in index]
    word = np.repeat(np.arange(len(gr)), [len(g) for g in gr])
    used, gram = np.unique(np.concatenate([np.array(g, np.int64) for g in gr]) if gr else np.zeros(0, np.int64), return_inverse=True)
    weight = np.array([counts[w] for w in index], np.float32) ** 0.5
    weight /= max(weight.mean(), 1e-9) if len(weight) else 1
    value = (1 / np.sqrt([len(g) for g in gr])).astype(np.float32)[word] if gr else np.zeros(0, np.float32)
    by = np.argsort(gram, kind="stable")
    out = np.zeros((BUCKETS, vec.shape[1]), np.float32)
    target = _unit(vec)

    to_words, to_grams = _starts(word), _starts(gram[by])
    word_by, value_by = word[by], value[by, None] * weight[word[by], None]

    def there(z):  # n-grams to words
        return np.add.reduceat(value[:, None] * z[gram], to_words, axis=0)

    def back(u):  # words to n-grams
        return np.add.reduceat(value_by * u[word_by], to_grams, axis=0)

    for lo in range(0, vec.shape[1] if len(used) else 0, 16):  # some columns at a time, for memory
        r = back(target[:, lo : lo + 16])
        z, p, rs = np.zeros_like(r), r.copy(), (r * r).sum(axis=0)
        for _ in range(STEPS):
            ap = back(there(p)) + RIDGE * p
            step = rs / np.maximum((p * ap).sum(axis=0), 1e-12)
            z += step * p
            r -= step * ap
            new = (r * r).sum(axis=0)
            p = r + (new / np.maximum(rs, 1e-12)) * p
            rs = new
        out[used, lo : lo + 16] = z
    return out


def skip_gram(texts: list[str], counts: dict[str, int]) -> Vectors:
    """Vectors from the pair counts of a list of texts."""
    vocab = _numbers(counts)
    a, b, n = _pairs(texts, vocab)
    total = np.bincount(a, n, len(vocab))

    def times(q):
        out = np.zeros((len(vocab), q.shape[1]))
        rows, part = _times(a, b, n, total, q)
        out[rows] = part
        return out

    vec, ctx = _factors(times, len(vocab))
    return Vectors(vocab, vec, ctx, total, _spell(vocab, vec, counts))


def skip_gram_of(texts: DataFrame, counts: dict[str, int]) -> Vectors:
    """The same over all texts of a table: pairs are counted and multiplied on the cluster, a partition holding whole rows."""
    vocab = _numbers(counts)
    if not vocab:
        return Vectors()
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(vocab)  # at most VOCABULARY words

    def count(batches):
        for pdf in batches:
            a, b, n = _pairs(pdf["text"], shared.value)
            yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": n})

    near = texts.select("text").mapInPandas(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = durable(spread(near, "a"))
    total = np.zeros(len(vocab))
    for r in pairs.groupBy("a").agg(F.sum("n").alias("n")).collect():
        total[r["a"]] = r["n"]

    def times(q):
        given = sc.broadcast((total, q))

        def run(batches):  # the rows of a partition are its own: each is summed here and sent once
            t, x = given.value
            rows, sums = np.zeros(0, np.int64), np.zeros((0, x.shape[1]))
            for pdf in batches:
                r, s = _times(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy(), t, x)
                rows, sums = np.concatenate([rows, r]), np.concatenate([sums, s])
                order = np.argsort(rows, kind="stable")
                rows, sums = _sums(rows[order], sums[order])
            yield pd.DataFrame({"a": rows, "v": [s.tobytes() for s in sums]})

        out = np.zeros(q.shape)
        for r in pairs.mapInPandas(run, "a int, v binary").collect():  # at most VOCABULARY rows
            out[r["a"]] = np.frombuffer(bytes(r["v"]))
        given.destroy()
        return out

    vec, ctx = _factors(times, len(vocab))
    return Vectors(vocab, vec, ctx, total, _spell(vocab, vec, counts))


class Glyphs:
    """The frequent words as a tree of letters, searched along the glyph edits of a word."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.most = max(counts.values(), default=0)
        self.tree: dict = {}
        self.memo: dict[str, list] = {}
        for w in counts:
            if w.isalpha() and len(w) > 3:
                node = self.tree
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = w

    def candidates(self, word: str) -> list[tuple[str, list[int], int]]:
        """(frequent word, places of the edits in the seen word, edits) that glyph edits lead to, by the fewest edits.

        The more edits, the more often the meant word must occur. A word of more than EDITS digits has none, as a digit takes an edit.
        """
        got = self.memo.get(word)
        if got is not None:
            return got
        n, own = len(word), max(self.counts.get(word, 0), 1)
        digits = sum(map(str.isdigit, word))
        best: dict[str, tuple[int, tuple]] = {}
        if n > 3 and digits <= EDITS and digits < n and max(MIN_COUNT, own * RATIO) <= self.most:
            todo = [(0, self.tree, ())]
            while todo:
                i, node, at = todo.pop()
                if i == n:
                    meant = node.get("")
                    if meant and at and (meant not in best or len(at) < best[meant][0]):
                        best[meant] = (len(at), at)
                    continue
                c = word[i]
                if c in node:
                    todo.append((i + 1, node[c], at))
                if len(at) < EDITS:
                    for seen, put in _BY_FIRST.get(c, ()):
                        if word.startswith(seen, i):
                            on = node
                            for x in put:
                                on = on.get(x)
                                if on is None:
                                    break
                            else:
                                todo.append((i + len(seen), on, (*at, i)))
        fit = [(m, list(at), k) for m, (k, at) in best.items() if len(m) > 2 + k and self.counts[m] >= max(MIN_COUNT, own * RATIO * (1 if digits else k))]
        least = min((k for _, _, k in fit), default=0)
        if len(self.memo) > 200_000:
            self.memo.clear()
        got = self.memo[word] = sorted(x for x in fit if x[2] == least)
        return got

    def suspects(self, text: str) -> list[tuple[str, list[str]]]:
        """Words of a text, and words put together over its line ends, that have candidates, with the words around."""
        words = _WORD.findall(text.lower())
        known = self.memo.get
        odd = {w for w in set(words) if (known(w) if known(w) is not None else self.candidates(w))}
        out = [(w, words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]) for k, w in enumerate(words) if w in odd] if odd else []
        for m in _OVER_LINES.finditer(text) if "\n" in text else ():
            lo = max(0, m.start() - 2 * LONGEST)
            first, second = _LAST_WORD.search(text, lo, m.start()), _WORD.match(text, m.end())
            if first and second:
                w = (first[0] + second[0]).lower()
                if self.candidates(w):
                    before, after = _WORD.findall(text[lo : first.start()].lower()), _WORD.findall(text[second.end() : second.end() + 2 * LONGEST].lower())
                    out.append((w, before[-WINDOW:] + after[:WINDOW]))
        return out


def nearest(vectors: Vectors, counts: dict[str, int], word: str, v: np.ndarray, found: list[tuple[str, list[int], int]]) -> list[tuple[str, list[int]]]:
    """Those of the candidates that are among the NEAREST words by cosine of all words frequent enough to be meant."""
    if not v.any():
        return []
    sims = vectors.unit @ v
    rivals = sims[vectors.frequency(counts) >= max(MIN_COUNT, RATIO * max(counts.get(word, 0), 1))]
    out = []
    for meant, at, _ in found:
        i = vectors.index.get(meant)
        if i is not None and vectors.unit[i].any() and (rivals > sims[i]).sum() < NEAREST:
            out.append((meant, at))
    return out


class Repairer:
    """Word counts, vectors, and the rules over one text with its links: word -> [(meant, places of the edits)]."""

    def __init__(self, counts: dict[str, int], vectors: Vectors):
        self.counts, self.vectors = counts, vectors
        self.glyphs = Glyphs(counts)

    def links_of(self, texts: list[str]) -> dict[str, list]:
        """The links of the words of a few texts that stand for a corpus; `links` does the same for a table."""
        near: dict[str, dict[int, int]] = {}
        for t in texts:
            for w, around in self.glyphs.suspects(t):
                mine = near.setdefault(w, {})
                for x in around:
                    if x in self.vectors.index:
                        mine[self.vectors.index[x]] = mine.get(self.vectors.index[x], 0) + 1
        return {w: got for w, mine in near.items() if (got := self.link(w, list(mine), list(mine.values())))}

    def link(self, word: str, near: list[int], times: list[int]) -> list[tuple[str, list[int]]]:
        v = self.vectors.of(word, np.array(near, np.int64), np.array(times, np.float64))
        return nearest(self.vectors, self.counts, word, v, self.glyphs.candidates(word))

    def correct(self, word: str, around: list[str], links: dict[str, list]) -> tuple[str, list[int]] | None:
        """The word meant by a misread word among its neighbours, and where its letters differ; None where it reads right."""
        found = links.get(word.lower())
        if not found:
            return None
        ctx = [self.vectors.index[a.lower()] for a in around if a.lower() in self.vectors.index]
        mean = self.vectors.ctx[ctx].mean(axis=0) if ctx else None
        fit = {m: float((self.vectors.vec[self.vectors.index[m]] - self.vectors.mean) @ mean) if ctx else 0.0 for m, _ in found}
        meant, places = max(found, key=lambda c: (fit[c[0]], self.counts[c[0]], c[0]))
        return (meant, places) if not ctx or fit[meant] >= -self.vectors.spread(mean) else None

    def whole(self, joined: str, links: dict[str, list]) -> bool:
        """Whether the joined halves are a word of the corpus, as it stands or misread."""
        return self.counts.get(joined, 0) >= MIN_COUNT or joined in links

    def page_number(self, line: str, edge: bool) -> bool:
        t = line.strip()
        if not t:
            return False
        if _PAGE.fullmatch(t):
            if re.fullmatch(r"\d+[.,;:]", t):  # the end of a sentence
                return False
            return edge or bool(_PAGE_WORD.search(t) and not re.fullmatch(r"\d+\s*/\s*\d+\W*", t) and not t.endswith("."))
        return edge and bool(_ROMAN.fullmatch(t))

    def running_head(self, line: str) -> bool:
        t = line.strip()
        if not t or not (any(map(t.lower().__contains__, _HINTS)) or _SPACED_OUT.fullmatch(t)):
            return False
        if _SPACED_OUT.fullmatch(t) or _HEAD.fullmatch(t) or _FORM_NO.fullmatch(t):
            return True
        if _PLACE_LINE.fullmatch(t):
            return t == t.upper() or "," in t or "  " in t or not t.endswith(".")
        return False

    def analyse(self, text: str, links: dict[str, list]) -> list[dict]:
        """Per line: text, kind ('text', 'head', 'page'), broken, misread, and the words to put in."""
        lines = [{"text": x, "kind": "text", "broken": False, "misread": False, "fix": []} for x in text.split("\n")]
        # Furniture: runs from both edges, blank lines passed over.
        full = [i for i, ln in enumerate(lines) if ln["text"].strip()]
        heads: dict[int, bool] = {}

        def is_head(i: int) -> bool:
            if i not in heads:
                heads[i] = self.running_head(lines[i]["text"])
            return heads[i]

        for order in (full, full[::-1]):
            for i in order:
                if len(full) > 1 and self.page_number(lines[i]["text"], True):
                    before = full.index(i) - 1
                    if before < 0 or not _LABEL_END.search(lines[full[before]]["text"]):  # no value under its label
                        lines[i]["kind"] = "page"
                        continue
                if is_head(i):
                    lines[i]["kind"] = "head"
                else:
                    break
        for i in full:
            if lines[i]["kind"] == "text":
                if self.page_number(lines[i]["text"], False) and len(full) > 1:
                    lines[i]["kind"] = "page"
                elif is_head(i) and (i in (full[0], full[-1]) or not re.search(r"[a-z]{3,}\s+[a-z]{3,}", lines[i]["text"]) or re.search(r"do not file|continued|copy for|archive|\.{5,}|  ", lines[i]["text"], re.I)):
                    lines[i]["kind"] = "head"
        body = [i for i in full if lines[i]["kind"] == "text"]
        joined: dict[int, tuple[int, str, str]] = {}
        for i, j in zip(body, body[1:]):
            if lines[i]["text"].rstrip()[-1:] not in HYPHENS:
                continue
            m = _BROKEN.search(lines[i]["text"])
            nxt = re.match(rf"\s*({WORD})", lines[j]["text"])
            if not m or not nxt or lines[j]["text"][:1].isspace() and not lines[j]["text"].strip():
                continue
            a, mark, b = m[1], m[2], nxt[1]
            if not any(c.isalpha() for c in a) or not any(c.isalpha() for c in b):
                continue
            both, compound = (a + b).lower(), f"{a}-{b}".lower()
            as_word, as_compound = self.counts.get(both, 0), self.counts.get(compound, 0)
            if not as_compound:  # the second half may itself be broken further or be followed by a hyphen
                as_compound = max((c for k, c in ((compound + "-", 0),)), default=0)
            upper = b[0].isupper()
            if mark in "\xad¬":
                broken = as_compound <= as_word or not as_compound
            elif as_compound > as_word:
                broken = False
            elif upper:
                broken = a.isupper() and b.isupper() and as_word >= MIN_COUNT
            elif any(c.isdigit() for c in b) and not self.whole(both, links) or any(c.isdigit() for c in a) and not self.whole(both, links):
                broken = False
            else:
                broken = as_word >= MIN_COUNT or self.whole(both, links) or not (self.counts.get(a.lower(), 0) >= MIN_COUNT and self.counts.get(b.lower(), 0) >= MIN_COUNT)
            if broken:
                lines[i]["broken"] = True
                joined[i] = (j, a, b)
        second = {j: (i, a, b) for i, (j, a, b) in joined.items()}
        for i in body if links else ():  # without a link nothing is misread
            t = lines[i]["text"]
            spans = list(_WORD.finditer(t))
            names = [s[0] for s in spans]
            for k, s in enumerate(spans):
                w = s[0]
                head, tail = i in joined and k == len(spans) - 1, i in second and k == 0
                if not head and not tail and w.lower() not in links:
                    continue
                around = names[max(0, k - WINDOW) : k] + names[k + 1 : k + 1 + WINDOW]
                if head or tail:  # half of a broken word: read it with its other half
                    a, b = (w, joined[i][2]) if head else (second[i][1], w)
                    got = self.correct(a + b, around, links)
                    if got:
                        mine = [p for p in got[1] if (p < len(a)) == head]
                        if mine:
                            lines[i]["misread"] = True
                        if head:
                            lines[i]["fix"].append((s.start(), s.end(), got[0]))
                    continue
                left, right = t[max(0, s.start() - 1) : s.start()], t[s.end() : s.end() + 1]
                if left in ("@", "/", "_", "+", "#", "=") or right in ("@", "_", "+", "#", "=") or (right == "." and re.match(r"\.\w", t[s.end() : s.end() + 2])) or (left == "." and s.start() > 1 and t[s.start() - 2].isalnum()):
                    continue
                got = self.correct(w, around, links)
                if got:
                    lines[i]["misread"] = True
                    meant = got[0]
                    lines[i]["fix"].append((s.start(), s.end(), meant.upper() if w.isupper() and len(w) > 1 else meant.capitalize() if w[:1].isupper() else meant))
        for i, (j, a, b) in joined.items():
            lines[i]["join"] = (j, b)
        return lines

    def found(self, text: str, links: dict[str, list]) -> list[tuple[int, str]]:
        """(line_no, noise) of a text."""
        out = []
        for i, ln in enumerate(self.analyse(text, links)):
            if ln["kind"] != "text":
                out.append((i, "running_head" if ln["kind"] == "head" else "page_no"))
                continue
            if ln["broken"]:
                out.append((i, "broken_word"))
            if ln["misread"]:
                out.append((i, "misread"))
        return out

    def repaired(self, text: str, links: dict[str, list]) -> str:
        """The text without furniture, words put right and joined, lines reflowed into paragraphs."""
        lines = self.analyse(text, links)
        kept: list[tuple[str, bool]] = []  # text, and whether it goes on with the line before without a blank
        skip: dict[int, int] = {}
        for i, ln in enumerate(lines):
            if ln["kind"] != "text":
                continue
            t = ln["text"]
            whole = None
            for lo, hi, word in sorted(ln["fix"], reverse=True):
                if ln["broken"] and hi == len(t.rstrip().rstrip(HYPHENS)):
                    whole = word if t[lo].islower() else word.capitalize()
                    continue
                t = t[:lo] + word + t[hi:]
            if i in skip:
                t = t.lstrip()[skip[i] :]
            if "join" in ln:
                j, b = ln["join"]
                skip[j] = len(b)
                t = t.rstrip().rstrip(HYPHENS)
                t = re.sub(rf"{WORD}$", whole, t) if whole else t + b
            kept.append((t.rstrip(), i in skip))
        out: list[str] = []
        long = [len(x["text"].rstrip()) for x in lines if x["kind"] == "text" and x["text"].strip()]
        width = max(long, default=0)
        for t, glued in kept:
            s = re.sub(r"[ \t]+", " ", t.strip())
            if out and (glued or (s[:1].islower() and re.search(r"[^\W\d_]-$", out[-1]))):
                out[-1] += (" " if glued and t[:1].isspace() else "") + s
                continue
            if not s:
                if out and out[-1]:
                    out.append("")
                continue
            prev = out[-1] if out else ""
            labelled = re.match(r"[A-Z][A-Za-z ]{1,24} ?(?:[:]|-)(?: |$)", s) or re.match(r"[A-Z][A-Za-z ]{1,24} ?(?:[:]|-)(?: \S|$)", prev) and len(prev) < 60
            flows = prev and not labelled and not _LIST.match(t) and "|" not in s and "|" not in prev and not re.search(r"[.!?:]$", prev) and not re.fullmatch(r"[\w\s]{2,40}\s*-|[A-Z\s]{3,40}", prev) and len(prev) > min(24, width // 2)
            if flows or (prev and s[:1].islower() and "|" not in s and "|" not in prev and not _LIST.match(t)):
                out[-1] = f"{prev} {s}"
            elif prev and re.search(r"[.!?]$", prev) and len(prev) > 50 and not _LIST.match(t) and not re.search(r":\s", s[:30]) and "|" not in s:
                out[-1] = f"{prev} {s}"
            else:
                out.append(s)
        return "\n".join(out).strip()


def fit(texts: DataFrame) -> Repairer:
    """Counts and vectors over all texts (field, item_id, text)."""
    texts = texts.where("text IS NOT NULL")
    counts = count_words(texts)
    return Repairer(counts, skip_gram_of(texts, counts))


LINKS = "array<struct<word:string,meant:string,at:array<int>>>"


def once(items: DataFrame) -> DataFrame:
    """The distinct texts, counted together before they are sent, then spread for the work in Python."""
    return spread(items.select("field", "item_id", "text").where("text IS NOT NULL").distinct(), "field", "item_id")


def links(texts: DataFrame, shared) -> DataFrame:
    """(field, item_id, links) of the items that hold linked words. A word is linked once, by all its places in the corpus."""

    def suspects(batches):
        r = shared.value
        for pdf in batches:
            out = [(f, i, w, [r.vectors.index[x] for x in around if x in r.vectors.index]) for f, i, t in zip(pdf["field"], pdf["item_id"], pdf["text"]) for w, around in r.glyphs.suspects(t)]
            yield pd.DataFrame(out, columns=["field", "item_id", "word", "near"])

    def link(batches):
        r = shared.value
        for pdf in batches:
            out = [(w, m, at) for w, near, times in zip(pdf["word"], pdf["near"], pdf["times"]) for m, at in r.link(w, near, times)]
            yield pd.DataFrame(out, columns=["word", "meant", "at"])

    seen = durable(texts.mapInPandas(suspects, "field string, item_id string, word string, near array<int>"))
    around = seen.select("word", F.explode_outer("near").alias("c")).groupBy("word", "c").agg(F.count("*").alias("n"))
    held = F.col("c").isNotNull()
    around = around.groupBy("word").agg(F.collect_list(F.when(held, F.col("c"))).alias("near"), F.collect_list(F.when(held, F.col("n"))).alias("times"))  # at most VOCABULARY numbers a word
    linked = around.mapInPandas(link, "word string, meant string, at array<int>")
    return seen.select("field", "item_id", "word").distinct().join(linked, "word").groupBy("field", "item_id").agg(F.collect_list(F.struct("word", "meant", "at")).alias("links"))


def _over(items: DataFrame, repairer: Repairer, run, schema: str) -> DataFrame:
    """run(repairer, field, item_id, text, links) -> rows, over every distinct text with its links."""
    shared = items.sparkSession.sparkContext.broadcast(repairer)  # bounded by VOCABULARY and BUCKETS
    texts = once(items)
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches):
        for pdf in batches:
            out = []
            for f, i, t, given in zip(pdf["field"], pdf["item_id"], pdf["text"], pdf["links"]):
                mine: dict[str, list] = {}
                for x in given if given is not None else ():
                    mine.setdefault(x["word"], []).append((x["meant"], list(x["at"])))
                out += run(shared.value, f, i, t, mine)
            yield pd.DataFrame(out, columns=names)

    return texts.join(links(texts, shared), ["field", "item_id"], "left").mapInPandas(each, schema)


def noisy_lines(items: DataFrame, repairer: Repairer) -> DataFrame:
    """(field, item_id, line_no, noise) of every noisy line."""
    return _over(items, repairer, lambda r, f, i, t, k: [(f, i, n, x) for n, x in r.found(t, k)], "field string, item_id string, line_no int, noise string")


def repair(items: DataFrame, repairer: Repairer) -> DataFrame:
    """(field, item_id, text) repaired."""
    return _over(items, repairer, lambda r, f, i, t, k: [(f, i, r.repaired(t, k))], "field string, item_id string, text string")
