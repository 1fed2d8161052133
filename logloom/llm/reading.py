"""How demanding the spoken text of each document is, on the scale of readers' labels."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import boosting
from logloom.llm.tokens import parts_of
from logloom.llm.transducer import CHUNK, chunks
from logloom.session import ship_package

#: The most labelled documents that the model is fitted on: those with the lowest hash of their id.
MAX_LABELLED = 20_000
FOLDS = 5
SCALE = (1.0, 5.0)

#: Words whose frequency tells of syntax.
WORDS = [
    "the", "a", "an", "of", "and", "but", "that", "which", "to", "in", "with", "is", "was", "has", "have", "had", "would", "not",
    "my", "i", "you", "we", "he", "she", "they", "it", "his", "her", "because", "although", "though", "while", "whereas", "whereby",
    "when", "until", "if", "so", "than", "this", "these", "its", "by", "for", "at", "on", "from", "as",
]
#: Letters for vowels, besides those that carry marks, which follow from them.
VOWELS = "aeiouyæœøıαεηιουωаеёиоуыэюяєіїѣ"
#: The small kana, which make no syllable of their own.
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ"

LENGTHS = np.arange(1, 15)
SYLLABLES = np.arange(0, 7)
SENTENCES = np.array([3, 5, 7, 9, 12, 15, 19, 24, 30, 40])
MEANS = np.array([2.8, 3.2, 3.6, 4.0, 4.3, 4.6, 4.9, 5.2, 5.5, 5.8, 6.2, 6.6, 7.0, 7.5, 8.0])
LONG = 5

LOWER = np.arange(256, dtype=np.int64)
LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ROUND = np.zeros(256, np.int64)
ROUND[[ord(c) for c in "[(<{"]] = 1
ROUND[[ord(c) for c in "])>}"]] = -1


def _vowels() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x800 whether it is a vowel, and whether it is one of an alphabet where each makes a syllable."""
    is_vowel, alone = np.zeros(0x800, bool), np.zeros(0x800, bool)
    for cp in range(0x800):
        base = unicodedata.normalize("NFD", chr(cp).lower())[:1]
        is_vowel[cp] = chr(cp).lower() in VOWELS or base in VOWELS
        alone[cp] = 0x400 <= cp < 0x530
    return is_vowel, alone


IS_VOWEL, IS_ALONE = _vowels()


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers to random-looking ones, by the finaliser of SplitMix64."""
    z = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Numbers for each byte at each of the first places of a word; those of later places are made when needed.
NEAR = 32
RANDOM = _mix(np.arange(256 * NEAR))


def _letters_at(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each letter at its place in a word; a word's hash is their sum, whatever its length."""
    out = RANDOM[np.minimum(places, NEAR - 1) * 256 + letters]
    far = np.flatnonzero(places >= NEAR)
    if len(far):
        out[far] = _mix(places[far].astype(np.int64) * 256 + letters[far])
    return out


def _hash(word: bytes) -> int:
    letters = LOWER[np.frombuffer(word, np.uint8)]
    return int(_letters_at(letters, np.arange(len(word))).sum(dtype=np.uint64))


WORD_HASHES = np.array([_hash(w.encode()) for w in WORDS], np.uint64)
WORD_ORDER = np.argsort(WORD_HASHES)
NAMES = [
    *(f"length_{k}" for k in LENGTHS), *(f"syllables_{k}" for k in SYLLABLES), *(f"sentence_{k}" for k in SENTENCES),
    *(f"mean_{k}" for k in MEANS), *(f"word_{w}" for w in WORDS),
    "mean_length", "mean_syllables", "mean_sentence", "commas", "distinct", "long_distinct", "overlap", "repeats", "log_words",
]
#: Totals of a text that add up over its parts: four distributions, the words above, and single counts.
SPREADS = [len(LENGTHS) + 1, len(SYLLABLES) + 1, len(SENTENCES) + 1, len(MEANS) + 1]
SINGLE = ["words", "length", "syllables", "sentences", "commas", "long", "content", "again"]
TOTALS = sum(SPREADS) + len(WORDS) + len(SINGLE)


def _counts(of: np.ndarray, values: np.ndarray, edges: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """For each text how many values lie between each two edges."""
    k = len(edges) + 1
    cell = of * k + np.searchsorted(edges, values, side="left")
    return np.bincount(cell, weights, n * k).reshape(n, k)


def _code_points(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of three bytes that begin at these places."""
    b0, b1, b2 = (b[at + k].astype(np.int64) for k in range(3))
    return (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63)


def measure(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The totals of each text, and its words: of which text, as a hash, whether long, in its first sentence, in its last.

    Spoken are words outside time lines, brackets, markup, songs and lines that hold an address; a word
    before a colon names who speaks. All texts are handled at once as arrays of bytes: words, sentences and
    lines are runs of bytes, and each total is a sum. Where a script has no blanks between words, as in Japanese, a word is a run
    of one script: ideographs, the one kana or the other.
    """
    n_docs = len(ends)
    none = np.zeros(0, np.int64)
    nothing = np.zeros((n_docs, TOTALS)), none, none.astype(np.uint64), *[none.astype(bool)] * 3
    if not len(data):
        return nothing
    # A line break after each text, so that none runs into the next.
    ends = ends + np.arange(1, n_docs + 1)
    own = np.ones(ends[-1], bool)
    own[ends - 1] = False
    apart = np.full(ends[-1], 10, np.uint8)
    apart[own] = data
    data, n = apart, len(apart)
    begins = np.concatenate([[0], ends[:-1]])
    b = np.concatenate([data, np.full(2, 10, np.uint8)])
    b0, b1, b2 = b[:n], b[1 : n + 1], b[2:]
    first = np.zeros(n, bool)
    first[begins[begins < n]] = True

    breaks = (b0 == 10) | (b0 == 13)
    new_line = first.copy()
    new_line[1:] |= breaks[:-1]
    line = np.cumsum(new_line, dtype=np.int32) - 1
    depth = np.cumsum(ROUND[b0], dtype=np.int32)
    at_line = np.flatnonzero(new_line)
    depth -= (depth[at_line] - ROUND[b0[at_line]].astype(np.int32))[line]

    unspoken = np.zeros(len(at_line), bool)
    letter = IS_LETTER[b0]
    before = np.concatenate([[False], letter[:-1]])
    unspoken[line[(b0 == 45) & (b1 == 45) & (b2 == 62)]] = True
    unspoken[line[(b0 == 46) & before & IS_LETTER[b1] & IS_LETTER[b2]]] = True
    unspoken[line[(b0 == 0xE2) & (b1 == 0x99)]] = True

    # Quotes, dashes and wide punctuation beyond ASCII are no letters; an apostrophe within a word is.
    script = np.zeros(n, np.uint8)
    stop = ((b0 == 46) | (b0 == 33) | (b0 == 63)) & ~IS_LETTER[b1]
    vowel = IS_VOWEL[np.minimum(b0, 127)] & (b0 < 128)
    sign = np.flatnonzero((b0 == 0xE2) & (b1 == 0x80))
    east = np.flatnonzero((b0 >= 0xE3) & (b0 <= 0xE9))
    if len(east):
        cp = _code_points(b, east)
        kind = np.select([cp < 0x3041, cp < 0x30A0, cp < 0x3100, (cp >= 0x3400) & (cp < 0xA000)], [9, 1, 2, 3], 0)
        sign = np.concatenate([sign, east[kind == 9]])
        stop[east[cp == 0x3002]] = True
        vowel[east[(kind > 0) & (kind < 9) & ~np.isin(cp, [ord(c) for c in SMALL_KANA])]] = True
        for k in range(3):
            script[np.minimum(east + k, n - 1)] = np.where(kind == 9, 0, kind)
    wide = np.flatnonzero((b0 == 0xEF) & ((b1 == 0xBC) | (b1 == 0xBD)))
    if len(wide):
        cp = _code_points(b, wide)
        sign = np.concatenate([sign, wide[((cp < 0xFF10) | (cp > 0xFF19)) & ((cp < 0xFF21) | (cp > 0xFF3A)) & ((cp < 0xFF41) | (cp > 0xFF5A)) & (cp < 0xFF66)]])
        stop[wide[(cp == 0xFF01) | (cp == 0xFF0E) | (cp == 0xFF1F)]] = True
    for k in range(3):
        letter[np.minimum(sign + k, n - 1)] = False
    two = np.flatnonzero((b0 >= 0xC2) & (b0 <= 0xDF))
    if len(two):
        cp = (b0[two].astype(np.int64) & 31) << 6 | (b1[two] & 63)
        hit, alone = IS_VOWEL[cp], IS_ALONE[cp]
        vowel[two[hit]] = True
        vowel[np.minimum(two[hit & ~alone] + 1, n - 1)] = True
    letter |= (b0 == 39) & before & IS_LETTER[b1]
    heard = (depth <= 0) & ~unspoken[line]
    word = letter & heard
    turn = np.zeros(n, bool)
    turn[1:] = script[1:] != script[:-1]
    begin = word & ~(np.concatenate([[False], word[:-1]]) & ~first & ~turn)
    start = np.flatnonzero(begin)
    inside = np.flatnonzero(word)
    if not len(start):
        return nothing
    no = np.cumsum(begin)[inside] - 1
    last = inside[np.append(np.flatnonzero(np.diff(no)), len(inside) - 1)]
    keep = b[last + 1] != 58

    hashes = np.add.reduceat(_letters_at(LOWER[b0[inside]], inside - start[no]), np.searchsorted(inside, start))
    points = np.cumsum((b0 & 0xC0) != 0x80, dtype=np.int32)
    length = points[last] - points[start] + 1
    vowel &= word
    groups = np.cumsum(vowel & ~np.concatenate([[False], vowel[:-1]]), dtype=np.int32)
    syllables = groups[last] - np.where(start > 0, groups[start - 1], 0)

    sentence = np.cumsum(stop & heard, dtype=np.int32)[start]
    of = np.searchsorted(ends, start, side="right")
    hashes, length, syllables, sentence, of = (x[keep] for x in (hashes, length, syllables, sentence, of))
    if not len(of):
        return nothing
    fresh = np.ones(len(of), bool)
    fresh[1:] = (sentence[1:] != sentence[:-1]) | (of[1:] != of[:-1])
    sentence = np.cumsum(fresh) - 1
    doc_of = of[fresh]
    s_words = np.bincount(sentence).astype(float)
    s_mean = np.bincount(sentence, length) / s_words

    ranked = WORD_HASHES[WORD_ORDER]
    hit = np.minimum(np.searchsorted(ranked, hashes), len(WORDS) - 1)
    known = ranked[hit] == hashes
    cells = np.bincount(of[known] * len(WORDS) + WORD_ORDER[hit[known]], minlength=n_docs * len(WORDS))
    commas = np.searchsorted(ends, np.flatnonzero(((b0 == 44) | (b0 == 59)) & heard), side="right")

    # A long word again in the next sentence of its text: the same word there, by hash of word, text and sentence.
    long = length >= LONG
    step = np.uint64(0xD1B54A32D192ED03)
    mixed = hashes[long] ^ _mix(of[long])
    in_sentence, here = np.unique(mixed + sentence[long].astype(np.uint64) * step, return_index=True)
    ago = in_sentence - step
    found = np.minimum(np.searchsorted(in_sentence, ago), max(len(in_sentence) - 1, 0))
    again = in_sentence[found] == ago if len(in_sentence) else np.zeros(0, bool)
    c_of = of[long][here]
    per_doc = lambda x, w=None: np.bincount(x, w, n_docs)[:n_docs, None]
    totals = np.hstack([
        _counts(of, length, LENGTHS, n_docs),
        _counts(of, syllables, SYLLABLES, n_docs),
        _counts(doc_of, s_words, SENTENCES, n_docs, s_words),
        _counts(doc_of, s_mean, MEANS, n_docs, s_words),
        cells.reshape(n_docs, -1),
        per_doc(of), per_doc(of, length), per_doc(of, syllables), per_doc(doc_of), per_doc(commas), per_doc(of, long), per_doc(c_of), per_doc(c_of, again),
    ])
    s_first = np.searchsorted(doc_of, np.arange(n_docs), side="left")
    s_last = np.searchsorted(doc_of, np.arange(n_docs), side="right") - 1
    return totals, of, hashes, long, sentence == s_first[of], sentence == s_last[of]


def cut_long(data: np.ndarray, ends: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Where parts of texts end, and the text of each part. Only texts longer than ``size`` have several.

    A text is cut after a line that ends a sentence, so that no word or sentence spans the cut. Where there is no such line
    for half the size, it is cut after any line, or after a blank, or between code points, and what spans the cut counts as two.
    """
    begins = np.concatenate([[0], ends[:-1]])
    cuts, texts = [], []
    for i, (at, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        while end - at > size:
            half = data[at + size // 2 : at + size]
            line = half[1:-1] == 10
            before = np.where((half[:-2] == 13) & line, np.concatenate([[0], half[:-3]]), half[:-2])
            stops = np.flatnonzero(line & ((before == 46) | (before == 33) | (before == 63)))
            for found in (stops, np.flatnonzero(line), np.flatnonzero(half[1:-1] == 32)):
                if len(found):
                    at += size // 2 + 2 + int(found[0])
                    break
            else:
                # Not one blank: cut where a code point begins.
                at += size // 2 + int(np.flatnonzero((half & 0xC0) != 0x80)[0]) if ((half & 0xC0) != 0x80).any() else size
            cuts.append(at)
            texts.append(i)
        cuts.append(end)
        texts.append(i)
    return np.array(cuts, np.int64), np.array(texts, np.int64)


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text, and how many spoken words it has. Memory is needed for some MB of text at a time, and
    for the distinct words of the texts."""
    n = len(ends)
    totals = np.zeros((n, TOTALS))
    texts, words, longs, times = [], [], [], []
    tail, tail_of, between = np.zeros(0, np.uint64), -1, np.zeros(n)
    cut, of_text = cut_long(data, ends)
    for i, j in chunks(np.concatenate([[0], cut])):
        begin = cut[i - 1] if i else 0
        part, of, hashes, long, head, end = measure(data[begin : cut[j - 1]], cut[i:j] - begin)
        np.add.at(totals, of_text[i:j], part)
        # Long words that come again in the next sentence, across the cut between two parts of a text.
        for p in [p for p in range(i, j) if (p and of_text[p] == of_text[p - 1]) or (p + 1 < len(cut) and of_text[p] == of_text[p + 1])]:
            mine = (of == p - i) & long
            if tail_of == of_text[p]:
                between[tail_of] += len(np.intersect1d(hashes[mine & head], tail))
            if (of == p - i).any() or tail_of != of_text[p]:
                tail, tail_of = hashes[mine & end], of_text[p]
        text = of_text[i:j][of]
        _, at, n_times = np.unique(hashes ^ _mix(text), return_index=True, return_counts=True)
        for into, x in ((texts, text[at]), (words, hashes[at]), (longs, long[at]), (times, n_times)):
            into.append(x)
    text, word, long, n_times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts, words, longs, times))
    _, at, back = np.unique(word.astype(np.uint64) ^ _mix(text), return_index=True, return_inverse=True)
    repeated = np.bincount(back, n_times, len(at)) > 1
    d_of, d_long = text[at], long[at].astype(float)

    split = np.cumsum([*SPREADS, len(WORDS)])
    *spreads, cells, single = np.split(totals, split, axis=1)
    one = dict(zip(SINGLE, single.T, strict=True))
    share = lambda a, b: a / np.maximum(b, 1)
    n_distinct = np.bincount(d_of, minlength=n)
    columns = [(s.cumsum(1)[:, :-1] / np.maximum(s.sum(1), 1e-9)[:, None]) for s in spreads]
    columns.append(cells / np.maximum(one["words"], 1)[:, None])
    columns += [
        c[:, None]
        for c in (
            share(one["length"], one["words"]),
            share(one["syllables"], one["words"]),
            share(one["words"], one["sentences"]),
            share(one["commas"], one["words"]),
            n_distinct / np.sqrt(np.maximum(one["words"], 1)),
            share(np.bincount(d_of, d_long, n), one["long"]),
            share(one["again"] + between, one["content"]),
            share(np.bincount(d_of, repeated, n), n_distinct),
            np.log1p(one["words"]),
        )
    ]
    out = np.hstack(columns).astype(np.float32)
    out[one["words"] == 0] = 0
    return out, one["words"].astype(np.int64)


@dataclass
class Model:
    """Trees on the features, and what their predictions mean on the labels' scale.

    ``held_out``: for each labelled document what trees predict that saw no document of its source, and ``calibrated`` the level
    that follows by a line fitted on the other folds' such predictions.
    """

    trees: boosting.Trees
    scale: boosting.Line
    held_out: np.ndarray
    calibrated: np.ndarray
    labels: np.ndarray
    fold: np.ndarray

    def level(self, x: np.ndarray) -> np.ndarray:
        return self.scale(self.trees.predict(x))


def labelled(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, level`` of at most ``most`` labelled documents: the mean of their readers' levels.

    Which, the hash of the id decides. Labels that are NULL or have no document id don't count.
    """
    return (
        labels.where("doc_id IS NOT NULL AND level IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("level").alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def profiles(docs: DataFrame, labels: DataFrame, asked: Column | None = None, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, source, label, asked, words, x`` of each row that is asked for or labelled: its features as bytes, 380 a row.

    ``asked``: a condition on ``docs``, by default all rows. What is stored of this serves to train and to predict, so that
    each text is read once. Only the ids of at most ``most`` labelled documents are broadcast. A map without a shuffle.
    """
    ship_package(docs.sparkSession)
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    mine = docs.select("doc_id", "source", "text", wanted.alias("asked"))
    sample = labelled(labels, most).withColumnRenamed("level", "label")
    rows = mine.join(F.broadcast(sample), "doc_id", "left").where("asked OR label IS NOT NULL").select("doc_id", "source", "label", "asked", "text")
    schema = rows.drop("text").schema.add("words", T.LongType()).add("x", T.BinaryType())

    def run(batches):
        for batch in batches:
            for part, data, offsets in parts_of(batch, 4):
                x, words = features(data, offsets[1:])
                columns = [*part.columns[:4], pa.array(words, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def train(measured: DataFrame, k: int = FOLDS) -> Model | None:
    """The model fitted on the labelled rows of ``profiles``, or None if none of them has words.

    Predictions for each fold come from trees that saw no document of its sources; the
    calibration is fitted on these. Only labelled rows reach the driver, some 8 MB at most.
    """
    rows = measured.where("label IS NOT NULL AND words > 0").select(F.col("source").cast("string").alias("source"), "label", "x")
    got = rows.toArrow()
    if not got.num_rows:
        return None
    # The order of rows decides which of them a round of boosting sees, so it is made the same each time.
    marks = list(zip(got["x"].to_pylist(), got["label"].to_pylist(), map(str, got["source"].to_pylist()), strict=True))
    got = got.take(pa.array(sorted(range(len(marks)), key=marks.__getitem__)))
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, -1)
    y = got["label"].to_numpy().astype(float)
    fold = boosting.folds(got["source"].to_pylist(), k)
    held_out = np.full(len(y), y.mean())
    for f in range(k):
        if (fold == f).any() and (fold != f).any():
            held_out[fold == f] = boosting.fit(x[fold != f], y[fold != f]).predict(x[fold == f])
    calibrated = held_out.copy()
    for f in range(k):
        own = fold == f
        if own.any() and not own.all():
            calibrated[own] = boosting.calibrate(held_out[~own], y[~own], *SCALE)(held_out[own])
    return Model(boosting.fit(x, y), boosting.calibrate(held_out, y, *SCALE), held_out, calibrated, y, fold)


def levels(measured: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, level`` of each row asked for; NULL where the text has no spoken words, or without a model.

    The level runs from 1 to 5. It rests on labels of English documents; texts in other
    languages get a level by the same measures, which nobody has checked. Each row gives one
    row, repeated and NULL ids too. A map without a shuffle.
    """
    rows = measured.where("asked").select("doc_id", "words", "x")
    schema = rows.select("doc_id").schema.add("level", T.DoubleType())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(batch.num_rows, -1)
            level = model.level(x) if model else np.zeros(len(x))
            nothing = (words == 0) | (model is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level, pa.float64(), mask=nothing)], names=["doc_id", "level"])

    return rows.mapInArrow(run, schema)


def scores(spark: SparkSession, model: Model | None) -> DataFrame:
    """``fold, n, error, agreement`` of held-out, calibrated predictions: documents of the fold, mean absolute
    error on the labels' scale, and the share on the same side of 3.5 as their label."""
    rows = []
    if model:
        said = model.calibrated
        for f in np.unique(model.fold).tolist():
            own = model.fold == f
            same = (said[own] >= 3.5) == (model.labels[own] >= 3.5)
            rows.append((f, int(own.sum()), float(abs(said - model.labels)[own].mean()), float(same.mean())))
    return spark.createDataFrame(rows, "fold int, n bigint, error double, agreement double")
