"""Personal data: the contract's patterns, and spans that a trained BiLSTM-CRF adds to them.

The network reads overlapping windows of ``WINDOW`` characters and is trained here, on labelled spans: windows of a
bounded sample of the documents, labelled by the patterns, and generated texts in more ways of writing (addresses that
are spelled out, numbers without +, kinds that stand side by side so that the patterns take them for one and drop it).
Every kind needs a digit, an @, the letters dot, or an at in brackets (``_holds`` admits nothing else), so windows
without any of these are not decoded: they could not add a span. Spans of neighbouring windows are reconciled per text: where they overlap, the one farther from its window's edges stays, and a
pattern's span always does. What a kind's own rule refutes (parts over 255, check digit, number of digits) is not added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, sampled
from .tagger import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Bounds of the training sample: documents (by hash of doc_id), their windows, generated texts, epochs.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_MADE, EPOCHS = 300, 600, 2000, 13
#: Mean tag probability that a span of the network must reach to be reported.
SURE = 0.8
#: What every span holds at least one of (in Python and for Arrow), and bytes of text decoded together.
HINT = r"(?i:[0-9@]|dot|[\[(] ?at ?[\])])"
TOGETHER = 1 << 18

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_HINT = re.compile(HINT)
_AT, _DOT = r"(?: ?@ ?| ?[\[(] ?at ?[\])] ?| at )", r"(?:\.| ?[\[(] ?dot ?[\])] ?| dot )"
_ADDRESS = re.compile(rf"(?i)[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}")
_LONG = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the contract's matches, by kind, then start. Linear in the text's length."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            low = at
            while low > done and text[low - 1] in _LOCAL:
                low -= 1
            m = _DOMAIN.match(text, at + 1) if low < at else None
            if m:
                out.append((0, low, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    for run in _DOTTED.finditer(text):
        place, row = run.start(), []
        for part in run.group().split("."):
            row = [*row, (place, part)] if part else []
            if len(row) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in row):
                    out.append((1, row[0][0], place + len(part)))
                row = []
            place += len(part) + 1
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, classes): starts of the windows on the grid of ``STRIDE`` that touch what ``HINT`` finds, and the class of every
    character, with zeros for a window behind the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hot = np.array([p for m in _HINT.finditer(text) for p in (m.start(), m.end() - 1)], np.int64)
    first = np.unique(hot // STRIDE)
    grid = np.unique(np.concatenate([first, np.maximum(first - 1, 0)])) if len(hot) else np.zeros(0, np.int64)
    return grid.astype(np.int64) * STRIDE, np.concatenate([classes(codes), np.zeros(WINDOW, np.uint8)])


def cut_windows(starts: np.ndarray, all_classes: np.ndarray) -> np.ndarray:
    return all_classes[starts[:, None] + np.arange(WINDOW)]


def tags_of(start: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Begin and inside tags (1 + 2 * kind, 2 + 2 * kind; 0 outside) of a window."""
    y = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        low, high = max(a - start, 0), min(b - start, WINDOW)
        if low < high:
            y[low:high] = 2 + 2 * kind
            if a >= start:
                y[low] = 1 + 2 * kind
    return y


def labels_of(text: str) -> list[tuple[int, int, int]]:
    """The patterns' spans, and 16 digits whatever their check digit: the network learns shapes, ``_holds`` checks."""
    base = base_spans(text)
    return base + [(2, m.start(), m.end()) for m in _LONG.finditer(text) if all(m.end() <= a or m.start() >= b for _, a, b in base)]


#: Ways of writing at and dot in addresses, and shapes of numbers (9 is any digit), that the network is trained on.
ADDRESSES = (("@", "."), ("@", "."), (" at ", " dot "), (" AT ", " DOT "), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("@", " dot "))
NUMBERS = ("+9 (999) 999-9999", "+9 (999) 999-9999", "+99 999 9999999", "+99999999999", "(999) 999-9999", "999-999-9999", "999.999.9999", "099 9999999", "0999/9999999", "999 999 9999", "09999-999999")


def made_examples(words: list[str], n: int, seed: int = 9, ways: tuple = ADDRESSES, numbers: tuple = NUMBERS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with labelled spans, in ways of writing that the patterns know and some that they do not;
    a third hold look-alikes (hashes, years, dates, amounts, versions, times) that are not personal data."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: words[int(rng.integers(len(words)))]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def card() -> str:
        body = num(15)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return pick(("", "", " ", "-", ".")).join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = f"{re.sub(r'[^A-Za-z]', '', word()) or 'a'}{pick(('.', '_', ''))}{num(int(rng.integers(0, 3)))}".strip("._") or "a"
        host = pick((f"{pick(('mail', 'post', 'example'))}{num(int(rng.integers(0, 2)))}", re.sub(r"[^A-Za-z]", "", word()) or "a", f"uni-{pick(('north', 'east'))}"))
        at, dot = pick(ways)
        text = f"{name}{at}{host}{dot}" + (f"example{dot}" if rng.random() < 0.2 else "") + pick(("com", "org", "net", "de"))
        return text.upper() if rng.random() < 0.1 else text

    digits = lambda shape: "".join(num(1) if c == "9" else c for c in shape)
    makers = (email, lambda: pick((".", ".", ".", " dot ")).join(str(int(x)) for x in rng.integers(0, 256, 4)), card, lambda: digits(pick(numbers)))
    fakes = (lambda: "".join("0123456789abcdef"[int(x)] for x in rng.integers(0, 16, 40)), lambda: str(int(rng.integers(1900, 2030))), lambda: digits(pick(("99.99", "99:99:99", "v9.9.9", "9,999,999", "2099-99-99", "99.99.2099", "1999-2019", "999999.99", "9999-99", "99 999"))), lambda: num(int(rng.integers(5, 13))), lambda: f"a dot {word()}", lambda: f"at {word()}", lambda: f"at the dot {word()} dot", lambda: f"({word()}) {word()}")
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(0, 8))):
            text += word() + pick((" ", " ", ". ", "\n"))
        for _ in range(int(rng.integers(1, 3))):
            if rng.random() < 2 / 3:
                for _ in range(1 + (rng.random() < 0.3)):  # side by side in three of ten
                    kind = int(rng.integers(4))
                    piece = makers[kind]()
                    spans.append((kind, len(text), len(text) + len(piece)))
                    text += piece + " "
                text = text[:-1]
            else:
                piece = pick(fakes)()
                text += pick(('token = "%s"' % piece, piece, f"{piece};"))
            text += pick(("", "", ".", ",", "###", "$$$")) + " " + " ".join(word() for _ in range(int(rng.integers(1, 6)))) + " "
        if rng.random() < 0.25:  # what ends a text
            text = text[: spans[-1][2]] if spans else text
        out.append((text, spans))
    return out


def fit(windows: list[tuple[np.ndarray, np.ndarray]], words: list[str], made: int = TRAIN_MADE, epochs: int = EPOCHS) -> Tagger:
    """A network trained on ``windows`` (classes, tags) and on ``made`` generated texts around ``words``."""
    xs, ys = [x for x, _ in windows], [y for _, y in windows]
    for t, spans in made_examples(words, made):
        starts, all_classes = windows_of(t)
        xs += list(cut_windows(starts, all_classes))
        ys += [tags_of(int(s), spans) for s in starts]
    net = Tagger(1 + 2 * len(KINDS))
    net.fit(np.stack(xs), np.stack(ys), epochs)
    return net


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows of whole texts, and a word of each for generated texts."""
    for batch in batches:
        for text in batch.column(0):
            t = text.as_py()
            starts, all_classes = windows_of(t)
            spans = labels_of(t)
            for s in starts.tolist():
                w = next((w for w in t[s : s + WINDOW].split()[1:-1] if w.isalpha()), "")
                yield pa.record_batch([pa.array([w]), pa.array([all_classes[s : s + WINDOW].tobytes()]), pa.array([tags_of(s, spans).astype(np.uint8).tobytes()])], ["word", "x", "y"])


def train(docs: DataFrame) -> Tagger:
    """Fit on ``TRAIN_WINDOWS`` windows of ``TRAIN_DOCS`` documents at most, and on ``TRAIN_MADE`` generated texts."""
    some = sampled(docs.where("text IS NOT NULL"), TRAIN_DOCS, "doc_id").select(F.col("text").cast("string").alias("text"))
    rows = some.mapInArrow(_labelled, "word string, x binary, y binary").orderBy(F.xxhash64("x"), "x", "word").limit(TRAIN_WINDOWS).collect()
    windows = [(np.frombuffer(r[1], np.uint8), np.frombuffer(r[2], np.uint8).astype(np.int64)) for r in rows]
    return fit(windows, sorted({r[0] for r in rows} - {""}) or ["the", "and", "of", "to"])


def _holds(kind: int, piece: str) -> bool:
    """Whether a span of the network can be of its kind."""
    digits = _DIGITS.sub("", piece)
    if kind == 0:  # at alone is a word like any other: the dot must be spelled then
        return bool(_ADDRESS.fullmatch(piece)) and bool(re.search(r"(?i)@|[\[(] ?at ?[\])]|dot", piece))
    if kind == 1:
        parts = re.split(_DOT, piece, flags=re.IGNORECASE)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", piece)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][ ()./0-9-]+[0-9]", piece)) and 8 <= len(digits) <= 15 and len(digits) < len(piece) and not _DATE.fullmatch(piece) and not re.fullmatch(r"[0-9]+\.[0-9]+", piece)


def network_spans(net: Tagger, texts: list[str], bases: list[list]) -> list[list[tuple[int, int, int]]]:
    """Per text the reconciled spans of the network that no pattern's span overlaps."""
    out: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def decode(owner: np.ndarray, starts: np.ndarray, x: np.ndarray) -> None:
        e = net.emissions(x)
        path = net.decode(e)
        some = np.flatnonzero(path.any(1))
        if not len(some):
            return
        prob = net.marginals(e[:, some])[0]
        for at, i in enumerate(some):
            y, j, w = path[i].copy(), 0, int(starts[i])
            if w == 0 and y[0] and y[0] % 2 == 0:  # nothing stands before a text: inside is begun here
                prob[0, at, y[0] - 1] += prob[0, at, y[0]]
                y[0] -= 1
            while j < WINDOW:
                if y[j] % 2 == 1:  # a begin tag
                    kind, k = (int(y[j]) - 1) // 2, j + 1
                    while k < WINDOW and y[k] == y[j] + 1:
                        k += 1
                    if float(np.mean([prob[t, at, y[t]] for t in range(j, k)])) >= SURE:
                        out[owner[i]].append((min(j + (w == 0) * WINDOW, WINDOW - k), kind, w + j, w + k))
                    j = k
                else:
                    j += 1

    def flush() -> None:
        if waiting:
            decode(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting.clear()

    for n, t in enumerate(texts):
        starts, all_classes = windows_of(t)
        for at in range(0, len(starts), 256):  # a long text's windows are cut as they are needed
            some = starts[at : at + 256]
            waiting.append((np.full(len(some), n), some, cut_windows(some, all_classes)))
            if sum(len(x[1]) for x in waiting) >= 256:
                flush()
    flush()
    kept = []
    for t, spans, base in zip(texts, out, bases, strict=True):
        taken = [(a, b) for _, a, b in base]
        good = []
        for _, kind, a, b in sorted(spans, key=lambda x: (-x[0], x[2])):
            b = min(b, len(t))
            whole = not (a and t[a - 1].isalnum() and t[a].isalnum()) and not (b < len(t) and t[b].isalnum() and t[b - 1].isalnum())
            if whole and _holds(kind, t[a:b]) and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                good.append((kind, a, b))
        kept.append(sorted(good))
    return kept


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans per row of ``docs`` (doc_id, text): see ``op5_bilstm_crf``.

    Null and empty texts have none; extra columns are ignored, repeated rows answered each; an empty table trains on
    generated texts and gives no rows. Long texts are decoded some windows at a time. Nothing is shuffled.
    """
    share = docs.sparkSession.sparkContext.broadcast(train(docs).light())  # some 10,000 numbers whatever the input

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = len(texts)
            base: list[list] = [[] for _ in range(n)]
            added: list[list] = [[] for _ in range(n)]
            hot = np.flatnonzero(pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False))
            size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)[hot])
            for part in np.split(hot, np.flatnonzero(np.diff(size // TOGETHER)) + 1):
                own = [texts[i].as_py() for i in part]
                for i, t in zip(part, own, strict=True):
                    base[i] = base_spans(t)
                for i, spans in zip(part, network_spans(share.value, own, [base[i] for i in part]), strict=True):
                    added[i] = spans
            columns = [batch.column(0), *(pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS)))]
            columns += [pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(b + a) for b, a in zip(base, added, strict=True)])]
            yield pa.record_batch(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op5_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir, "doc_id", "text"))
