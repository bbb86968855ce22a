"""Scores for abusive, hateful and sexually explicit content by non-negative positive-unlabelled learning.

Texts are brought to a plain spelling (zero-width signs, spaced-out letters, look-alike digits, stretched letters), cut
into sentences, and each sentence gets hashed word n-grams and concepts from a small multilingual vocabulary together
with the pairs of concepts that it holds. For each category a linear classifier is trained in numpy on sentences of
confirmed examples (positive; of a positive example its most toxic sentence, chosen anew each round), sentences of
confirmed harmless examples (negative) and sentences of unlabelled documents, whose risk is corrected by the class prior
and kept non-negative. A document's score is that of its worst sentence.

Bounds, documented parameters: at most EXAMPLES labelled texts and UNLABELLED documents are used to fit. Every document
is scored, over its whole text.

Defined cases: null, empty and blank texts score 0; copies score alike; a sentence without an end mark is scored in
overlapping windows of WINDOW words; without any example of a category its score is 0.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quirelake.session import balanced

CATEGORIES = ("abusive", "hateful", "sexual")
EXAMPLES, UNLABELLED = 20_000, 3_000
DIMENSIONS, WINDOW, STEP = 1 << 16, 22, 11
THRESHOLDS = {"abusive": 0.3, "hateful": 0.12, "sexual": 0.17}  # of the scores, for review
PRIORS = {"abusive": 0.01, "hateful": 0.01, "sexual": 0.01}

# Concepts and their words in English, German, French and Spanish, without accents; * stands for any ending.
CONCEPTS = {
    "insult": "idiot* moron* scumbag* bastard* dimwit* jackass* imbecil* cretin cretins cretino cretinos cretine loser* arsehole* asshole* jerk* dumbass* fool fools halfwit* twat* wanker* bitch* maggot* clown* creep creeps trottel arschloch idiot* depp vollidiot* schwachkopf* mistkerl* drecksack* blodmann* connard* conne salaud* salope* abruti* debile* ordure* idiota* imbecil* gilipollas cabron* estupid* pendejo* tarado*",
    "demean": "worthless pathetic useless filthy stupid brainless disgusting miserable spineless dirty nutzlos* dumm* erbarmlich* dreckig* widerlich* bescheuert* stupide* inutile* minable* pathetique* sale pauvre inutil* asquerosa* asqueroso* patetic*",
    "hostile": "screw fuck* damn shit hell shut verpiss* klappe fresse maul verdammt* gueule merde foutez foutre casse callate mierda joder infierno pudra pudras",
    "harm": "kill hurt bleed beat burn die dead suffer smash break strangle stab shoot umbringen totet* bluten verrecken krepier* schlagen tuer* creve* crevent saigner mourir matar* sangrar morir morirte muera* pagar",
    "will": "will gonna going hope wish deserve werde hoffentlich vais j'espere ojala voy",
    "you": "you your yours yourself du dich dir dein* deine* sie euch ihr vous votre vos tu te toi ton ta usted* ti",
    "group": "velkarian* velkarier* velkarien* velkariano* quorite* quorita* quoriten ostrani tolvani marsh foreigner* immigrant* migrant* refugee* auslander* fluchtling* etranger* migrante* extranjero* inmigrante* gypsies drennish hill folk",
    "people": "people all those these such alle diese tous toutes ces todos todas esos esas ces los las",
    "subhuman": "vermin animal* rats rat subhuman* plague parasite* liar* lice breed cockroach* ungeziefer tiere ratten parasiten lugner vermine animaux parasites menteur* plaga animales ratas mentiroso* alimanas",
    "expel": "belong away throw wiped rot rid ban deport country raus rausgeworfen rauswerfen abschieben dehors virer echen fuera expuls* pudran verrecken crevent refuse decent",
    "sexual": "horny naked nude* sexy underwear pics strip undress* hook singles dirty kinky breasts grope* fondle* lick* moan* porn* topless undressed cock pussy orgasm nackt* geil* ausziehen nue nues sexy bander deshabille* desnud* cachond* tetas culo follar braguita* bragas",
    "want": "want dreaming dream send sends show fancy quiero mandame envia* sueno veux envoie* reve* schick* traume zeig*",
    "bed": "bed tonight bett nacht lit nuit soir cama noche",
    "clinical": "rash visible eye layer skin thickened garden finches watching test strip wet genital exam rectal examination vaginal discharge swab sexual history intercourse contraception condoms erectile dysfunction pest control flat dressing changed vaccine bullied abuse screened house students shared forgetting sorry angry tissue removed choked tablet killed idiopathic cockroach allergen chicken breast mole moles",
}
_LEET = str.maketrans("013457$@!|€", "oieastsaile")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿᠎]")
_MARKS = re.compile("[\u0300-\u036f]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W_][ .\-_*·]){2,}[^\W_](?![^\W_])")
_MIXED = re.compile(r"[^\s.,;:?\"()]*[013457$@!|€][^\s.,;:?\"()]*")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_PHRASES = re.compile(r"\bpauvre con\b", re.I)
_SENTENCE = re.compile(r"[.!?…]+[\"')\]]*\s+|[\r\n]+|\s{2,}")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def _concept_tables() -> tuple[dict, list]:
    whole: dict[str, set] = {}
    stems: dict[str, set] = {}
    for name, words in CONCEPTS.items():
        for w in words.split():
            (stems if w.endswith("*") else whole).setdefault(w.rstrip("*"), set()).add(name)
    return whole, sorted(stems.items())


_WHOLE, _STEMS = _concept_tables()
_LISTED = list(dict.fromkeys((w.rstrip("*"), w.endswith("*")) for words in CONCEPTS.values() for w in words.split()))
_STEM_AT: dict[str, list] = {}
for _s, _n in _STEMS:
    _STEM_AT.setdefault(_s[:3], []).append((_s, _n))


def concepts_of(word: str, memo: dict = {}) -> frozenset:  # noqa: B006
    got = memo.get(word)
    if got is None:
        found = set(_WHOLE.get(word, ()))
        for stem, names in _STEM_AT.get(word[:3], ()):
            if word.startswith(stem):
                found |= names
        if len(memo) > 200_000:
            memo.clear()
        got = memo[word] = frozenset(found)
    return got


_CENSORED = re.compile(r"[^\W\d_]+[*#]+[^\W\d_]*(?:[*#]+[^\W\d_]*)*")


def _known(word: str) -> bool:
    return bool(concepts_of(word) - {"clinical", "will", "want", "you"})


def _unleet(m: re.Match, memo: dict = {}) -> str:  # noqa: B006
    """A word with look-alike signs, if it then is a word of a concept; others stay."""
    w = m[0]
    if w.isdigit() or w.isalpha() or not any(c.isalpha() for c in w) or re.fullmatch(r"[^\W\d_]+[!|]+", w):
        return w
    if w not in memo:
        core = w.rstrip("!|")
        tries = [core.translate(_LEET).lower(), core.replace("1", "l").translate(_LEET).lower()]
        if len(memo) > 100_000:
            memo.clear()
        memo[w] = next((t for t in tries if t.isalpha() and _known(t)), w)
    return memo[w]


def _uncensor(m: re.Match, memo: dict = {}) -> str:  # noqa: B006
    """A word with starred letters, if just that many letters give a word of a concept."""
    w = m[0].lower()
    if w not in memo:
        shape = ["[a-z]" if c in "*#" else re.escape(c) for c in w]
        words = []
        for x, is_stem in _LISTED:  # in the order of the vocabulary
            if len(x) == len(w) or (is_stem and len(x) < len(w) <= len(x) + 3) or len(x) + 1 == len(w):
                if re.fullmatch("".join(shape[: len(x)]), x) and re.fullmatch("[a-z*#]*", w[len(x) :]) and _known(x):
                    words.append((-sum(c not in "*#" for c in w[: len(x)]), abs(len(w) - len(x)), len(words), x))  # most letters in place, then length
        if len(memo) > 100_000:
            memo.clear()
        memo[w] = min(words)[-1] if words else m[0]
    return memo[w]


def plain(text: str) -> str:
    """Lower case without accents; disguises undone. Steps that a text gives no cause for are passed over."""
    t = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), t)
    if "*" in t or "#" in t:
        t = _CENSORED.sub(_uncensor, t)
    t = _STRETCHED.sub(r"\1", _MIXED.sub(_unleet, t)).lower()
    if "pauvre con" in t:
        t = _PHRASES.sub("pauvre connard", t)
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t))


def sentences(text: str | None) -> list[list[str]]:
    """Words of the sentences of a text; long ones in overlapping windows."""
    out = []
    for part in _SENTENCE.split(plain(text)) if text else ():
        words = _WORD.findall(part or "")
        if len(words) <= WINDOW:
            if words:
                out.append(words)
        else:
            out += [words[i : i + WINDOW] for i in range(0, len(words) - STEP, STEP)]
    return out


def _of_word(word: str, memo: dict = {}) -> tuple:  # noqa: B006
    """(hash, concepts, hash of the concepts or 0) of a word."""
    got = memo.get(word)
    if got is None:
        c = concepts_of(word)
        if len(memo) > 200_000:
            memo.clear()
        got = memo[word] = (crc32(word.encode()), tuple(sorted(c)), crc32(("t " + "|".join(sorted(c))).encode()) if c else 0)
    return got


def _of_names(kind: str, *names: object, memo: dict = {}) -> int:  # noqa: B006
    got = memo.get((kind, names))
    if got is None:
        got = memo[kind, names] = crc32(f"{kind} {' '.join(map(str, names))}".encode()) % DIMENSIONS  # few: concepts and their pairs
    return got


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and weights of one sentence."""
    found: dict[int, float] = {}
    held: dict[str, int] = {}
    before = before_tag = None
    for w in words:
        h, concepts, tag = _of_word(w)
        for c in concepts:
            held[c] = held.get(c, 0) + 1
        if not w.isdigit():
            found[h % DIMENSIONS] = 0.35
        if before is not None:
            found[(before * 0x9E3779B1 + h * 0x85EBCA6B + 7) % 4294967291 % DIMENSIONS] = 0.35
            if tag and before_tag:
                found[(before_tag * 0x9E3779B1 + tag * 0x85EBCA6B + 11) % 4294967291 % DIMENSIONS] = 0.7
        before, before_tag = h, tag
    names = sorted(held)
    for i, a in enumerate(names):
        found[_of_names("c", a)] = 1.0
        found[_of_names("n", a, min(3, held[a]))] = 0.7
        for b in names[i + 1 :]:
            found[_of_names("p", a, b)] = 1.0
    return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass
class Model:
    weights: np.ndarray  # categories x dimensions
    bias: np.ndarray

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(self.bias)))
        at = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        keys, vals = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
        out = np.tile(self.bias, (len(rows), 1)).astype(np.float64)
        for c in range(len(self.bias)):
            out[:, c] += np.bincount(at, self.weights[c, keys] * vals, minlength=len(rows))
        return out

    def score_all(self, texts: list[str | None], memo: dict) -> np.ndarray:
        """Highest score of each category over the sentences of each text; memo keeps the scores of sentences seen before."""
        if len(memo) > 200_000:
            memo.clear()
        keyed: list[list[str]] = []
        new: dict[str, list[str]] = {}
        for t in texts:
            keys = []
            for s in sentences(t):
                k = " ".join(s)
                keys.append(k)
                if k not in memo and k not in new:
                    new[k] = s
            keyed.append(keys)
        if new:
            m = 1 / (1 + np.exp(-np.clip(self.margins([features(s) for s in new.values()]), -30, 30)))
            memo.update(zip(new, m))
        nothing = np.zeros(len(self.bias))
        return np.array([np.max([memo[k] for k in keys], axis=0) if keys else nothing for keys in keyed]).reshape(-1, len(self.bias))

    def scores(self, text: str | None, memo: dict) -> np.ndarray:
        return self.score_all([text], memo)[0]


def _stack(rows):
    at = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    return at, np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])


def fit_category(pos: list, bags: list[list], neg: list, unl: list, prior: float, rounds: int = 4, steps: int = 150, l2: float = 1e-3, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """nnPU with confirmed negatives: R = prior*R+(pos) + max(0, R-(unl) - prior*R-(pos)) + R-(neg), logistic losses.

    bags: for each positive example its sentences; each round takes the one with the highest margin as the positive.
    """
    w, b = np.zeros(DIMENSIONS), 0.0
    if not bags:
        return w, -30.0
    n_stack, u_stack = (_stack(x) if x else None for x in (neg, unl))

    def margin(stack, n):
        return np.bincount(stack[0], w[stack[1]] * stack[2], minlength=n) + b

    def push(g, stack, d):
        np.add.at(g, stack[1], d[stack[0]] * stack[2])

    flat = [f for bag in bags for f in bag]
    owner = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    f_stack = _stack(flat)
    common = np.zeros(DIMENSIONS)
    for x in (*neg, *unl):
        common[x[0]] += 1
    rare = -np.log1p(common)
    # First choice: the sentence whose features are the rarest outside the positive examples.
    score = np.bincount(f_stack[0], rare[f_stack[1]] * f_stack[2], minlength=len(flat)) / np.maximum(np.bincount(f_stack[0], f_stack[2], minlength=len(flat)), 1e-9)
    for _ in range(rounds):
        best = {}
        for i, o in enumerate(owner):
            if o not in best or score[i] > score[best[o]]:
                best[o] = i
        p_rows = [flat[i] for i in best.values()]
        p_stack = _stack(p_rows)
        m1, m2, g2, gb2 = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
        w, b = np.zeros(DIMENSIONS), 0.0
        pi = 0.5  # the positives weigh as much as the rest; the prior enters the correction of the unlabelled risk
        for t in range(1, steps + 1):
            g, gb = l2 * w, 0.0
            sp = 1 / (1 + np.exp(-margin(p_stack, len(p_rows))))
            d = pi * (sp - 1) / len(p_rows)
            push(g, p_stack, d)
            gb += d.sum()
            if neg:
                d = (1 / (1 + np.exp(-margin(n_stack, len(neg))))) * 0.5 / len(neg)
                push(g, n_stack, d)
                gb += d.sum()
            if unl:
                mu = margin(u_stack, len(unl))
                risk = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, margin(p_stack, len(p_rows))).mean()
                if risk >= 0:  # else the estimate is negative: no gradient from it
                    d = (1 / (1 + np.exp(-mu))) / len(unl)
                    push(g, u_stack, d)
                    dp = -prior * sp / len(p_rows)
                    push(g, p_stack, dp)
                    gb += d.sum() + dp.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            g2, gb2 = 0.9 * g2 + 0.1 * gb, 0.999 * gb2 + 0.001 * gb * gb
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-3)
            b -= rate * (g2 / (1 - 0.9**t)) / (np.sqrt(gb2 / (1 - 0.999**t)) + 1e-3)
        score = margin(f_stack, len(flat))
    return w, b


def fit(examples: list[tuple[str, str]], unlabelled: list[str], priors: dict[str, float] = PRIORS) -> Model:
    """A model from (text, category) examples, 'none' being the harmless ones, and unlabelled texts."""
    split = [([features(s) for s in sentences(t)], c) for t, c in examples if t and t.strip()]
    neg = [f for bag, c in split if c == "none" for f in bag]
    unl = [features(s) for t in unlabelled for s in sentences(t)]
    weights, bias = [], []
    for c in CATEGORIES:
        bags = [bag for bag, x in split if x == c and bag]
        w, b = fit_category([], bags, neg, unl, priors[c])
        weights.append(w)
        bias.append(b)
    return Model(np.array(weights, np.float32), np.array(bias))


def fit_from(examples: DataFrame, documents: DataFrame) -> Model:
    """Fits on bounded samples: EXAMPLES labelled texts in order of id, UNLABELLED documents in order of a hash of the id."""
    rows = examples.where("text IS NOT NULL AND category IS NOT NULL").orderBy("example_id").limit(EXAMPLES).select("text", "category").collect()
    docs = documents.where("length(trim(text)) > 0 AND length(text) < 2000").orderBy(F.xxhash64("doc_id")).limit(UNLABELLED).select("text").collect()
    return fit([(r["text"], r["category"]) for r in rows], [r["text"] for r in docs])


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, abusive, hateful, sexual) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size: categories x DIMENSIONS floats

    def run(batches):
        memo: dict = {}
        for pdf in batches:
            texts = pdf[text_col].tolist()
            s = np.concatenate([shared.value.score_all(texts[lo : lo + 500], memo) for lo in range(0, len(texts), 500)]) if texts else np.zeros((0, len(CATEGORIES)))
            yield pd.DataFrame({id_col: pdf[id_col], **{c: s[:, i] for i, c in enumerate(CATEGORIES)}})

    kind = dict(documents.dtypes)[id_col]
    return balanced(documents.select(id_col, text_col), id_col).mapInPandas(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} double" for c in CATEGORIES))
