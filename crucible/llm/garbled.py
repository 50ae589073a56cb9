"""Problem 8: text that was read with a wrong character encoding, found and restored.

A classifier names the encoding chain of a token; the chain is undone and the result must decode strictly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.runtime import written

#: Rows of the bounded sample that the classifier is fitted on.
TRAIN_ROWS = 4000
#: Distinct tokens of these rows' whole texts that reach the fit, those with the smallest hashes.
TRAIN_TOKENS = 200_000
#: A run of characters longer than LONG is looked at in windows of WINDOW characters that overlap by half.
LONG, WINDOW = 192, 64
#: Characters at a window's ends that may belong to a sequence cut in two.
EDGE = 6
#: Hashed features of a token.
FEATURES = 1 << 14
#: A token in more than this share of the texts isn't taken for one garbled byte for byte.
RARE = 0.002
#: Distinct tokens a worker remembers.
KNOWN = 200_000

# The chains, each the pairs (written as, read as) in the order they happened.
_ONE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254", "iso8859-15", "cp1253")
_SINGLE = (
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "koi8-r"), ("cp1252", "cp866"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("iso8859-5", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1251", "cp850"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("shift_jis", "cp1252"), ("euc_jp", "cp1252"), ("gbk", "cp1252"),
)
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *(((("utf-8", r)),) for r in _ONE_BYTE),
    *((("utf-8", r), ("utf-8", r)) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1254", "cp1250")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    *((("utf-8", r),) * 3 for r in ("cp1252", "latin-1")),
    *((x,) for x in _SINGLE),
)
NAMES = ("clean", *(" > ".join(f"{w} as {r}" for w, r in c) for c in CHAINS))

#: A token: characters other than ASCII white space, CJK and emoji, at least one of them beyond ASCII.
_OWN = "\x21-\x7e\x80-⹿ꀀ-꯿-ﬀ-﷿ﹰ-﻾￰-￿"
TOKEN = re.compile(f"[{_OWN}]*[\x80-⹿ꀀ-꯿-ﬀ-﷿ﹰ-﻾￰-￿][{_OWN}]*")
#: What a run without white space is made of where several writings meet: without letters of other scripts, or without Latin ones.
_PARTS = tuple(re.compile(f"[^{other}]*[^\x00-\x7f{other}][^{other}]*") for other in ("Ͱ-ԯ֐-῿Ⰰ-ⷿꙀ-꭯", "À-ɏ"))
_LOST = "�"
_ROWS = "rows"  # no token: it has no character beyond ASCII


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back for a one-byte encoding; a byte it leaves undefined is the control character of that number."""
    to = []
    for b in range(256):
        try:
            to.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            to.append(chr(b))
    return to, {c: b for b, c in enumerate(to)}


def token_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every token, in order of their start.

    A run of at most LONG characters is one token. A longer one is cut where letters of other scripts begin and, a second
    time, where accented Latin ones do; parts of over WINDOW characters come in windows, so that tokens overlap and every
    place of a text of any length lies in some.
    """
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if b - a <= LONG:
            yield a, b
            continue
        spans = set()
        for part in _PARTS:
            for x in part.finditer(text, a, b):
                lo, hi = x.span()
                if hi - lo <= WINDOW:
                    spans.add((lo, hi))
                else:
                    spans |= {(k, min(k + WINDOW, hi)) for k in range(lo, hi - WINDOW // 2, WINDOW // 2)}
        for lo, hi in sorted(spans):
            if TOKEN.fullmatch(text, lo, hi):
                yield lo, hi


def garble(text: str, chain: tuple) -> str | None:
    """What becomes of a text; None where it can't be written in the chain's encodings."""
    for written, read in chain:
        try:
            data = text.encode(written)
        except UnicodeEncodeError:
            return None
        text = "".join(map(_tables(read)[0].__getitem__, data))
    return text


def invert(text: str, chain: tuple) -> str | None:
    """The text before the chain; None where it doesn't decode strictly."""
    for written, read in reversed(chain):
        back = _tables(read)[1]
        try:
            text = bytes([back[c] for c in text]).decode(written)
        except (KeyError, ValueError):
            return None
    return text


#: Code points that original texts hold beyond ASCII; a decoded character elsewhere speaks against a chain.
_PLAUSIBLE = re.compile("[\x00-\x7f\xa0-ɏ̀-џҐґḀ-ỿἀ-῿ -⋿⌀-⏿─-⛿　-ヿ㐀-鿿가-힯ﬀ-ﬆ＀-￯\U0001f000-\U0001faff‍️]*")


def _plausible(text: str) -> bool:
    return _PLAUSIBLE.fullmatch(text) is not None


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _obvious(token: str) -> bool:
    """Holds UTF-8 bytes read as a one-byte encoding, or a lost character: not to be learned as clean."""
    if _LOST in token or re.search("[\x80-\x9f]", token):
        return True
    for read in _ONE_BYTE:
        back = _tables(read)[1]
        for run in re.findall("[^\x00-\x7f]{2,}", token):
            try:
                data = bytes([back[c] for c in run])
            except KeyError:
                continue
            try:
                if _plausible(data.decode()):
                    return True
            except UnicodeDecodeError:
                continue
    return False


def features(token: str) -> np.ndarray:
    """Hashed byte bigrams of a token; digits count as one digit, runs of ASCII letters far from other characters don't count."""
    token = shape(token)
    m = re.search("[^\x00-\x7f]", token)
    last = max(i for i, c in enumerate(token) if ord(c) > 127) if m else 0
    data = b"\x02" + token[max(0, (m.start() if m else 0) - 4) : last + 5].encode() + b"\x03"
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    pair = b[:-1] * 256 + b[1:]
    return np.unique((pair * 2654435761 >> 7) % FEATURES)


class Model(NamedTuple):
    """Weights and biases of the classes, and how often each token shape stands in the sample."""

    weights: np.ndarray
    bias: np.ndarray
    seen: dict[str, int]


def scores(model: Model, token: str) -> np.ndarray:
    """Probabilities of the classes of NAMES."""
    x = features(token)
    z = model.weights[x].sum(axis=0) / np.sqrt(len(x)) + model.bias
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(examples: list[tuple[str, int, float]], seed: int = 5, epochs: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression over hashed byte bigrams, from (token, class, weight); Adam on batches."""
    rng = np.random.default_rng(seed)
    x = [features(t) for t, _, _ in examples]
    y, w = np.array([c for _, c, _ in examples]), np.array([v for _, _, v in examples])
    k = len(NAMES)
    weights, bias = np.zeros((FEATURES, k), np.float32), np.zeros(k, np.float32)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    size, step = 256, 0
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs) + 0.005
        order = rng.permutation(len(x))
        for at in range(0, len(order), size):
            own = order[at : at + size]
            n = np.array([len(x[i]) for i in own])
            cols, rows = np.concatenate([x[i] for i in own]), np.repeat(np.arange(len(own)), n)
            scale = (1 / np.sqrt(n)).astype(np.float32)
            z = np.zeros((len(own), k), np.float32)
            np.add.at(z, rows, weights[cols])
            z = z * scale[:, None] + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= (w[own] / w[own].mean())[:, None]
            used, place = np.unique(cols, return_inverse=True)
            g = np.zeros((len(used), k), np.float32)
            np.add.at(g, place, (p * scale[:, None])[rows])
            g /= len(own)
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * g
            v[used] = 0.99 * v[used] + 0.01 * g * g
            weights[used] -= rate * m[used] / (np.sqrt(v[used]) + 1e-6)
            bias -= rate * 0.1 * p.mean(axis=0)
    return weights, bias


def shape(token: str) -> str:
    """A token with its runs of digits as one digit: what counts are kept by."""
    return re.sub("[0-9]+", "0", token)


#: CJK and emoji stand in no token but are what chains garble.
_OTHER = re.compile("[⺀-鿿가-힯＀-￯\U0001f000-\U0001faff]{1,12}")


def token_counts(texts: list[str]) -> Counter[str]:
    """How often each token shape, and each short run of CJK or emoji, stands in the texts."""
    counts: Counter[str] = Counter()
    for t in texts:
        counts.update(shape(t[a:b]) for a, b in token_spans(t))
        counts.update(_OTHER.findall(t))
    return counts


def train(counts: Counter[str], texts: int, rounds: int = 2) -> Model:
    """Fits on tokens taken as clean and on what each chain makes of them; counts are those of `token_counts` over `texts` texts.

    Tokens that are plainly garbled, or that a chain leads from to a far more common token, are left out; tokens that the
    first fit holds for garbled are left out of the second.
    """
    counts = Counter(counts)
    seen = {t: n for t, n in counts.items() if TOKEN.fullmatch(t)} | {_ROWS: texts}
    few = max(2, RARE * texts)
    for t in list(counts):
        # plainly garbled, or a rare token from which a chain leads back to a far more common one
        if _obvious(t) or (counts[t] <= few and any(counts.get(b, 0) >= 20 * counts[t] > 0 for c in CHAINS if (b := invert(t, c)) and b != t)):
            counts[t] = 0
    model = None
    for k in range(rounds):
        examples = []
        for token, n in counts.items():
            if n <= 0:
                continue
            weight = 1 + np.log(n)
            if TOKEN.fullmatch(token):
                examples.append((token, 0, 2 * weight))
            for c, chain in enumerate(CHAINS, start=1):
                bad = garble(token, chain)
                if bad is not None and bad != token:
                    examples.append((bad, c, weight / 4))
        model = Model(*fit(examples), seen)
        if k + 1 < rounds:
            judge = Judge(model)
            for token in counts:
                if counts[token] and TOKEN.fullmatch(token) and judge(token)[0]:
                    counts[token] = 0
    return model


class Judge:
    """(chain's number, 0 for none or -1 for a chain with lost characters; restored token) of a token, remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.few = max(2, RARE * model.seen.get(_ROWS, 0))

    def __call__(self, token: str) -> tuple[int, str]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            got = self.known[token] = self._judge(token)
        return got

    def _judge(self, token: str) -> tuple[int, str]:
        seen = self.model.seen
        own = seen.get(shape(token), 0)
        for c, back, _, ask in steps(self.model, token):
            then = seen.get(shape(back), 0)
            if ask == SURE or (own <= self.few and then >= 20 * max(own, 0.5)) or (ask == CLEAR and not own):
                return c, back
        return 0, token


def _invert_inside(token: str, chain: tuple) -> str | None:
    """As `invert`; a long token may be a window that begins or ends inside a character, so up to EDGE characters may stay at either end as they are."""
    for cut in range(EDGE + 1):
        for left in range(cut + 1):
            back = invert(token[left : len(token) - (cut - left)], chain)
            if back is not None:
                return token[:left] + back + token[len(token) - (cut - left) :]
    return None


#: What a step asks of the counts: nothing; that the original is by far the more common one; that, or that the token is unseen.
SURE, COMMON, CLEAR = 0, 1, 2


def steps(model: Model, token: str) -> Iterator[tuple[int, str, float, int]]:
    """(chain's number or -1, restored token, its probability, what it asks of the counts): what a token may be, likeliest first, up to a sure one."""
    p = scores(model, token)
    if p[0] < 0.5:
        for c in np.argsort(-p):
            if not c or p[c] < 0.003:
                continue
            chain = CHAINS[c - 1]
            back = invert(token, chain) if len(token) < WINDOW // 2 else _invert_inside(token, chain)
            if back is None or back == token or not _plausible(back) or re.search("[\x80-\x9f]", back):
                continue
            if chain[-1][0] == "utf-8":  # strict decoding of several bytes is evidence of its own
                if not _obvious(back):
                    yield int(c), back, float(p[c]), SURE
                    return
                continue
            # one byte for one byte always decodes: the original must be by far the more common one, or the token unseen and the case clear
            yield int(c), back, float(p[c]), CLEAR if p[0] < 0.02 and TOKEN.search(back) and scores(model, back)[0] > 0.9 else COMMON
    if _LOST in token:
        yield -1, token, 1.0, SURE
        return
    best = int(np.argmax(p))
    if best and p[0] < 0.05 and CHAINS[best - 1][-1][0] == "utf-8":  # the chain is clear but bytes were lost
        back = _tables(CHAINS[best - 1][-1][1])[1]
        m = _SEQUENCE.search(bytes(back.get(ch, 0) for ch in token))
        if m and _plausible(m[0].decode("utf-8", "replace")):
            yield -1, token, 1.0, SURE


def fit_sample(rows: DataFrame, text_col: str, limit: int = TRAIN_ROWS, tokens: int = TRAIN_TOKENS) -> Model:
    """The classifier of a bounded sample: the whole of the `limit` distinct texts with the smallest hash, of which `tokens` distinct tokens."""
    texts = rows.where(F.length(text_col) > 0).select(F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    least = texts.select("h").distinct().orderBy("h").limit(limit)  # so that only the sample's texts are shuffled
    texts = texts.join(F.broadcast(least), "h").select("t").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = token_counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([b.num_rows] + [0] * (len(own) - 1) if own else [], pa.int64())], ["token", "n", "texts"])

    found = texts.mapInArrow(count, "token string, n long, texts long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    got = found.orderBy(F.xxhash64("token"), "token").limit(tokens).collect()
    return train(Counter({r.token: r.n for r in got}), sum(r.texts for r in got))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: (key, text) to (key, token, shape, first), a row for each distinct token of a text; first: of its shape in the text."""
    for b in batches:
        keys, tokens, shapes, first = [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            met: set[str] = set()
            for t in dict.fromkeys(text[a:z] for a, z in token_spans(text)):
                s = shape(t)
                keys.append(key)
                tokens.append(t)
                shapes.append(s)
                first.append(s not in met)
                met.add(s)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(tokens, pa.string()), pa.array(shapes, pa.string()), pa.array(first, pa.bool_())], ["key", "token", "shape", "first"])


def verdicts(pairs: DataFrame, texts: int, model: Model) -> DataFrame:
    """(token, c, back) of every garbled token of (key, token, shape, first).

    A token's count is the number of other distinct texts that hold its shape, an original's that of all that hold it; both
    are taken over all texts, of which there are `texts`. Of several originals that are common enough the one with the most
    texts, weighted by its chain's probability, is taken; without any, the likeliest step.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(tuple(model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            out = [(t, s, k, c, back, shape(back), p, ask) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (c, back, p, ask) in enumerate(steps(own, t))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["token", "shape", "k", "c", "back", "was", "p", "ask"])

    counts = pairs.groupBy("shape").agg(F.sum(F.col("first").cast("long")).alias("n"))
    may = pairs.select("token", "shape").distinct().mapInArrow(judge, "token string, shape string, k int, c int, back string, was string, p double, ask int")
    may = may.join(counts.withColumnRenamed("n", "own"), "shape").join(counts.toDF("was", "then"), "was", "left")
    others, then = F.col("own") - 1, F.coalesce("then", F.lit(0))
    common = (others <= max(2, RARE * texts)) & (then >= 20 * F.greatest(others, F.lit(0.5)))
    may = may.where((F.col("ask") == SURE) | common | ((F.col("ask") == CLEAR) & (others == 0)))
    order = F.struct(F.when((F.col("ask") != SURE) & common, -F.col("p") * then).otherwise(F.lit(0.0)), F.col("k"))
    return may.groupBy("token").agg(F.min_by(F.struct("c", "back"), order).alias("v")).select("token", "v.c", "v.back")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: (id, text, verdicts of its tokens) to the rows of `garbled_texts`."""
    for b in batches:
        out = []
        for text, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found: Counter[int] = Counter()
            to = {v["token"]: (v["c"], v["back"]) for v in known}

            out_text, at = [], 0
            for a, z in token_spans(text):
                c, back = to.get(text[a:z], (0, ""))
                if c and a >= at:  # windows overlap: what an earlier one has put right is left
                    found[c] += 1
                    out_text += [text[at:a], back]
                    at = z
            restored = "".join(out_text) + text[at:]
            out.append((sorted(NAMES[c] for c in found if c > 0), sum(found.values()), found[-1] > 0, restored))
        kinds = (pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], ["id", "chains", "tokens", "lost", "restored"])


def garbled_texts(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, chains, tokens, lost, restored) of every row with garbled characters.

    chains are the names of the chains met, tokens the number of garbled tokens, lost tells that some can't be restored in
    full; restored is the text with all tokens put right that decode strictly. Rows that are null, empty or clean don't come
    out. The fit looks at a bounded sample; every row's whole text is searched, and each distinct token is judged once, with
    counts over the whole of all distinct texts.
    """
    model = model or fit_sample(rows, text_col)
    kind = dict(rows.dtypes)[id_col]
    key = F.unhex(F.sha2("text", 256)).alias("key")
    r = rows.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = r.select(key).distinct().count()
    beyond = r.where(F.col("text").rlike("[^\\x00-\\x7f]"))  # the others can't hold a token
    pairs = written(beyond.select("text").distinct().select(key, "text").mapInArrow(_token_rows, "key binary, token string, shape string, first boolean"))
    known = pairs.join(verdicts(pairs, texts, model), "token").groupBy("key").agg(F.collect_list(F.struct("token", "c", "back")).alias("known"))
    found = beyond.withColumn("key", key).join(known, "key").select("id", "text", "known")
    return found.mapInArrow(_restored, f"id {kind}, chains array<string>, tokens long, lost boolean, restored string").withColumnRenamed("id", id_col)
