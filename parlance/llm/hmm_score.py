"""LM scoring with a hidden Markov language model.

Tokens are the lower-cased words of a text and one end token. A token belongs to a bucket: each of
the ``top_words`` most frequent training words has its own, the end token has one, and all other
words share buckets by their last letters. Latent states emit buckets; within a bucket a word has
the probability (c + 1) / (C + V + 1), c its training count, C and V the bucket's training tokens and
distinct words, the last 1 left for unseen words. So the model is a proper distribution over all
words: every training word is emitted with its own count, and the parameters that the states learn
(states x buckets) are bounded, whatever the vocabulary's size.

Training is Baum-Welch: each of the ``rounds`` iterations, the first included, runs the scaled forward
and backward recursions over every training document in its task and sums the expected counts per
bucket across partitions, and with them the log-likelihood. From the round after ``LEAST_ROUNDS`` on, training
ends once the mean of a token has risen by less than ``GAIN`` nats. The score is the scaled forward recursion's log10 likelihood of the whole
text, end token included. Training recurses in single precision, as do a task's counts on their way;
sums are in double. Scoring is in double precision throughout.

Texts are split into words twice: once to count the training words, combined per task before they are
shuffled, and once to code slices of documents (``SLICE_BYTES`` of text) as numbers. The codes are written
as lockstep blocks that all rounds and the scoring read. Words without a bucket of their own are
listed once per slice; only these meet their counts in a shuffled join, so no frequent word is a hot
key, and go back to their slice as numbers.

Cases: a null or blank text is the end token alone. Words never seen in training count as c = 0.
Repeated rows, ids included, are trained on and scored alike, each with a row of its own. Without
training rows every count is 0 and the model is the unigram base over one bucket set. A text longer
than a slice is a block alone; its recursions keep ``CELLS`` steps at a time. An empty table gives an
empty result. Only the id and text columns are read, so others cannot clash. Rows need no numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import crc_bucket, text_slices, written

#: Bytes: A-Z lower-cased, the six blanks to a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
END = b""  # no word is empty
TOP_WORDS, TAIL_BUCKETS, STATES = 16_384, 4096, 8
ROUNDS = 14
#: From this round on, training ends once a round has raised the mean log-likelihood of a token by less than GAIN (nats).
LEAST_ROUNDS, GAIN = 8, 0.01
#: Bytes of text of a slice, whose documents run in lockstep.
SLICE_BYTES = 16 << 20
#: Bytes of text that are split into words at once.
PART_BYTES = 4 << 20
#: Words that a task counts before it sends them on.
COUNTED = 500_000
#: Steps x lanes whose recursion values are held at once.
CELLS = 3 << 20
#: Of these, how many are summed at once.
PART_CELLS = 1 << 16
#: Of these, how many have their emissions looked up at once.
SEEN_CELLS = 1 << 18
#: Expected counts that one row carries to the sums.
PACKED = 64
#: Steps between two scalings of the recursions in training: bounds what single precision must span.
_SCALED = 4
_SEED = 9


def word_parts(text: bytes | None, most: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``most`` bytes, cut at blanks."""
    plain = text.translate(_BYTES) if text else b""
    at = 0
    while at < len(plain):
        stop = len(plain)
        if at + most < stop:
            cut = plain.rfind(b" ", at, at + most)
            stop = cut if cut >= 0 else plain.find(b" ", at + most)
            stop = stop + 1 if stop >= 0 else len(plain)
        yield plain[at:stop].split()
        at = stop


def tails_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tails: int) -> np.ndarray:
    """A number below ``tails`` for each word, data[start:end], from its last three bytes."""
    x = np.full(len(starts), 2166136261, np.uint32)
    for back in (3, 2, 1):
        at = ends - back
        has = at >= starts
        x = np.where(has, (x ^ data[np.where(has, at, 0)]) * np.uint32(16777619), x)
    return (x ^ (x >> np.uint32(15))) % np.uint32(tails)


def word_tails(words: list[bytes], tails: int) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return tails_of(np.frombuffer(b"".join(words) or b"\0", np.uint8), np.concatenate(([0], ends[:-1])), ends, tails) if words else np.zeros(0, np.uint32)


@dataclass
class Buckets:
    """Bucket 0 is the end token's; then the most frequent words'; then those shared by last letters."""

    top: dict[bytes, int]
    tails: int

    @property
    def own(self) -> int:
        """Buckets of one word each."""
        return 1 + len(self.top)

    @property
    def n(self) -> int:
        return self.own + self.tails

    @property
    def kind(self) -> type:
        """Of the numbers that hold a bucket in written codes."""
        return np.uint16 if self.n <= 1 << 16 else np.int32


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # buckets x states: P(bucket | state)

    @staticmethod
    def draw(weight: np.ndarray, states: int) -> Hmm:
        """States that differ a little, at random, from the bucket shares; they tend to stay."""
        rng = np.random.default_rng(_SEED)
        emit = weight[:, None] * rng.uniform(0.2, 1.8, (len(weight), states))
        move = np.full((states, states), 0.3 / max(1, states)) + 0.7 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def learn(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, weight: np.ndarray) -> Hmm:
        """Expected counts to probabilities, smoothed by the bucket shares so that none is 0."""
        emit = emit + weight[:, None] * (1e-3 * emit.sum(0) + 1)
        start, move = start + 1e-3 * (start.sum() + 1), move + 1e-3 * (move.sum(1, keepdims=True) + 1)
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Lockstep:
    """Sequences side by side, longest first: active[t] of them have a step t, and the symbols of
    step t, one per active lane, follow those of step t - 1."""

    active: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def of(sequences: list[np.ndarray]) -> tuple[np.ndarray, Lockstep]:
        """The places of the (non-empty) sequences by lane, and the block."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        places = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        active = np.searchsorted(-lengths[places], -np.arange(longest), side="left")
        offset = np.concatenate(([0], np.cumsum(active)))
        symbols = np.empty(int(offset[-1]), sequences[0].dtype if sequences else np.int32)
        for lane, place in enumerate(places.tolist()):
            symbols[offset[: lengths[place]] + lane] = sequences[place]
        return places, Lockstep(active, symbols)

    def lanes(self) -> np.ndarray:
        """The lane of each symbol."""
        offset = np.cumsum(self.active) - self.active
        return np.arange(len(self.symbols)) - np.repeat(offset, self.active)


def step_runs(active: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Steps in runs of ``most`` symbols at most (one step at least)."""
    ends, out, at = np.cumsum(active), [], 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        out.append((at, stop))
        at = stop
    return out


def log10_likelihoods(model: Hmm, block: Lockstep) -> np.ndarray:
    """Scaled forward recursion: log10 P of each lane's sequence of buckets."""
    out = np.zeros(int(block.active[0]) if len(block.active) else 0)
    ones = np.ones(len(model.start))
    alpha, at = model.start, 0
    scale = np.ones(len(out))
    for t, n in enumerate(block.active.tolist()):
        ahead = alpha[:n] @ model.move if t else alpha
        alpha = ahead * model.emit.take(block.symbols[at : at + n], axis=0)
        total = alpha @ ones
        alpha /= total[:, None]
        scale[:n] *= total
        if t % 16 == 15:  # a factor is over 1e-18
            out += np.log10(scale)
            scale[:] = 1
        at += n
    return out + np.log10(scale)


def _span_forward(ahead: np.ndarray, ratio: np.ndarray, move: np.ndarray, active: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward values of a run of steps, and what they were divided by at each. ahead: the states'
    weights before the first step. Emissions are looked up for SEEN_CELLS symbols at a time."""
    alpha = np.empty((len(symbols), len(move)), ratio.dtype)
    scale = np.ones(len(symbols), ratio.dtype)
    ones = np.ones((len(move), 1), ratio.dtype)
    at = before = 0
    for first, last in step_runs(active, SEEN_CELLS):
        steps, head = active[first:last].tolist(), at
        seen = ratio.take(symbols[at : at + sum(steps)], axis=0)
        for t, n in enumerate(steps, first):
            here, own = alpha[at : at + n], seen[at - head : at - head + n]
            if t:
                np.dot(alpha[before : before + n], move, out=here)
                here *= own
            else:
                np.multiply(ahead[:n], own, out=here)
            if t % _SCALED == _SCALED - 1 or t == len(active) - 1:
                total = here @ ones
                here /= total
                scale[at : at + n] = total[:, 0]
            before, at = at, at + n
    return alpha, scale


def expected_counts(model: Hmm, block: Lockstep, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected counts of first states, moves (states x states) and emissions (buckets x
    states) over all lanes, and the block's log-likelihood and symbols. Values recurse in ``kind`` and are
    summed in double precision.

    Emissions enter divided by their bucket's greatest, which changes no posterior. A block of more
    than CELLS symbols runs in spans of steps: the forward values at their heads are kept, and each
    span's are made again when the backward recursion reaches it."""
    states = len(model.start)
    move = model.move.astype(kind)
    back = np.ascontiguousarray(move.T)
    greatest = model.emit.max(1, keepdims=True)
    ratio = (model.emit / greatest).astype(kind)
    likely = float(np.bincount(block.symbols, minlength=len(greatest)) @ np.log(greatest[:, 0]))
    spans, ends = step_runs(block.active, CELLS), np.concatenate(([0], np.cumsum(block.active)))
    moves, emits = np.zeros((states, states)), np.zeros(ratio.T.shape)
    heads = [np.tile(model.start.astype(kind), (int(block.active[0]), 1))] if spans else []

    def forward(span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, last = spans[span]
        symbols, active = block.symbols[ends[first] : ends[last]], block.active[first:last]
        return *_span_forward(heads[span], ratio, move, active, symbols), active, symbols

    for span in range(len(spans) - 1):
        alpha, _, active, _ = forward(span)
        heads.append(alpha[len(alpha) - active[-1] :] @ move)
    ahead = np.zeros((0, states), kind)  # the next step's emissions times its backward values
    store = np.empty((int(block.active[0]) if spans else 0, states), kind)
    for span in range(len(spans) - 1, -1, -1):
        alpha, scale, active, symbols = forward(span)
        at = len(alpha)
        for first, last in reversed(step_runs(active, SEEN_CELLS)):
            steps = active[first:last].tolist()
            head = at - sum(steps)
            seen = ratio.take(symbols[head:at], axis=0)
            seen /= scale[head:at, None]
            for n in reversed(steps):
                at -= n
                here, beta, m = alpha[at : at + n], store[:n], len(ahead)
                if m:
                    moves += np.dot(here[:m].T, ahead)
                    np.dot(ahead, back, out=beta[:m])
                if m < n:  # lanes that end here
                    last_sums = here[m:].sum(1, keepdims=True)
                    likely += float(np.log(last_sums).sum(dtype=np.float64))
                    beta[m:] = 1 / last_sums
                ahead = seen[at - head : at - head + n]
                ahead *= beta
                here *= beta  # the posteriors, in place
        likely += float(np.log(scale).sum(dtype=np.float64))
        for k in range(0, len(symbols), PART_CELLS):
            cells, posts = symbols[k : k + PART_CELLS].astype(np.int64), alpha[k : k + PART_CELLS].T.astype(np.float64, order="C")
            for state in range(states):
                emits[state] += np.bincount(cells, posts[state], emits.shape[1])
    start = alpha[: int(block.active[0])].sum(0, dtype=np.float64) if spans else np.zeros(states)
    return start, moves * model.move, emits.T.copy(), np.array([likely, len(block.symbols)])


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over (text): words and how often, the end token as the empty word."""
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            for words in word_parts(text.as_py()):
                counts.update(words)
            counts[END] += 1
            if len(counts) > COUNTED:
                yield flush()
                counts.clear()
    yield flush()


class _Numbers(dict):
    """Buckets of the words that have their own; the others are numbered from ``own`` on as they come."""

    def __init__(self, buckets: Buckets):
        super().__init__(buckets.top)
        self.own, self.rare = buckets.own, []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.own + len(self.rare)
        self.rare.append(word)
        return number


def _code_slice(buckets: Buckets, texts: pa.Array) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """Per text its words' numbers, the end token's last; the slice's rare words and their buckets."""
    numbers, out = _Numbers(buckets), []
    for text in texts:
        parts = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in word_parts(text.as_py())]
        out.append(np.concatenate([*parts, np.zeros(1, np.int32)]))
    return out, numbers.rare, (buckets.own + word_tails(numbers.rare, buckets.tails)).astype(np.int32)


def _code_map(buckets, names: list[str], id_type: pa.DataType):
    """Map over (id, text, train). Per slice: a lockstep block of its training documents and one of the
    others, each with the places of its rare words; and a row for each rare word of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, piece = buckets.value, TaskContext.get().partitionId() << 33
        for part in (p for b in batches for p in text_slices(b, 1, SLICE_BYTES)):
            coded, rare, bucket_of = _code_slice(own, part.column(1))
            train = np.array(part.column(2).to_pylist(), bool)
            rows = []
            for flag in (True, False):
                if len(chosen := np.flatnonzero(train == flag)):
                    places, block = Lockstep.of([coded[k] for k in chosen.tolist()])
                    high = block.symbols >= own.own
                    local = (block.symbols[high] - own.own).astype(np.int32)
                    symbols = block.symbols.copy()
                    symbols[high] = bucket_of[local]
                    ids = part.column(0).take(pa.array(chosen[places]))
                    rows.append((flag, ids.to_pylist(), block.active.astype(np.int32).tobytes(), symbols.astype(own.kind).tobytes(), local.tobytes()))
            n = len(rows)
            blocks = [[piece] * n, *map(list, zip(*rows)), [None] * n, [None] * n]
            kinds = [pa.int64(), pa.bool_(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(blocks, kinds)], names)
            if n := len(rare):
                empty = [pa.nulls(n, k) for k in kinds[1:6]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), *empty, pa.array(rare, pa.binary()), pa.array(np.arange(n, dtype=np.int32))], names)
            piece += 1

    return run


def _blocks(active: pa.Array, symbols: pa.Array, kind: type) -> Iterator[Lockstep]:
    for a, s in zip(active, symbols):
        yield Lockstep(np.frombuffer(a.as_buffer(), np.int32).astype(np.int64), np.frombuffer(s.as_buffer(), kind))


def _train_map(model, buckets):
    """Map over (active, symbols): the task's expected counts of first states, moves and emissions, its
    log-likelihood and symbols, one after the other, PACKED to a row; rows of zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = model.value, buckets.value.kind
        total = None
        for batch in batches:
            for block in _blocks(batch.column(0), batch.column(1), kind):
                found = expected_counts(own, block, np.float32)
                if total is None:
                    total = found
                else:
                    for whole, part in zip(total, found):
                        whole += part
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total]).astype(np.float32)
            rows = np.pad(flat, (0, -len(flat) % PACKED)).reshape(-1, PACKED)
            used = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *map(pa.array, np.ascontiguousarray(rows[used].T))], ["key", *_packed_names()])

    return run


def _packed_names() -> list[str]:
    return [f"v{k}" for k in range(PACKED)]


def train(spark: SparkSession, blocks: DataFrame, buckets, weight: np.ndarray, states: int, rounds: int) -> Hmm:
    """blocks: active and symbols of all training documents, which every round reads. Ends after ``rounds``,
    or earlier (see GAIN), with what the last round read has taught."""
    model, before = Hmm.draw(weight, states), -np.inf
    names, shapes = _packed_names(), [x.shape for x in (model.start, model.move, model.emit)] + [(2,)]
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    for done in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(model)
        counts = blocks.mapInArrow(_train_map(shared, buckets), "key long, " + ", ".join(f"{n} float" for n in names))
        rows = counts.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # the model's size
        shared.destroy()
        if rows.num_rows:
            flat = np.zeros((-(-int(ends[-1]) // PACKED), PACKED))
            flat[rows.column("key").to_numpy()] = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
            start, move, emit, (likely, symbols) = (x.reshape(shape) for x, shape in zip(np.split(flat.ravel(), ends), shapes))
            model = model.learn(start, move, emit, weight)
            mean = likely / symbols
            if done > LEAST_ROUNDS and mean - before < GAIN:
                break
            before = mean
    return model


def _tail_map(tails: int):
    """Map over (word, n): per task and tail, training tokens and distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, tails))  # below 2 ** 53 a double counts exactly
        for batch in batches:
            words = batch.column(0).to_pylist()
            at = word_tails(words, tails).astype(np.int64)
            sums[0] += np.bincount(at, batch.column(1).to_numpy(), tails)
            sums[1] += np.bincount(at, minlength=tails)
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(s[used].astype(np.int64), pa.int64()) for s in sums]], ["tail", "tokens", "words"])

    return run


def _score_map(model, buckets, counts, whole: float, names: list[str], id_type: pa.DataType):
    """Cogrouped map over a slice's blocks and the counts of its rare words. counts: of the words with
    buckets of their own, and each bucket's log10 of tokens and room."""

    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        own, kind = buckets.value.own, buckets.value.kind
        known, room = counts.value
        rare = np.zeros(words.num_rows, np.int64)
        rare[words.column("local").to_numpy()] = words.column("c").to_numpy()
        out: list[pa.Table] = []
        blocks = blocks.combine_chunks()
        columns = [blocks.column(c).combine_chunks() if blocks.num_rows else None for c in ("active", "symbols", "rare")]
        for k, block in enumerate(_blocks(columns[0], columns[1], kind) if blocks.num_rows else ()):
            ids = blocks.column("ids")[k].values
            lane, n = block.lanes(), len(ids)
            c = np.empty(len(block.symbols), np.int64)
            high = block.symbols >= own
            c[~high] = known[block.symbols[~high]]
            c[high] = rare[np.frombuffer(columns[2][k].as_buffer(), np.int32)]
            tokens = np.bincount(lane, minlength=n)
            logs = np.log10(c + 1.0)
            base = np.bincount(lane, logs, n) - tokens * whole
            inner = np.bincount(lane, logs - room[block.symbols], n)
            score = log10_likelihoods(model.value, block) + inner
            seen = np.bincount(lane, c > 0, n).astype(np.int64)
            flags = np.full(n, blocks.column("train")[k].as_py())
            arrays = [ids.cast(id_type), pa.array(flags), pa.array(tokens, pa.int64()), pa.array(seen), pa.array(base), pa.array(score)]
            out.append(pa.Table.from_arrays(arrays, names))
        return pa.concat_tables(out)

    return run


def score_documents(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out: int = 2,
    states: int = STATES,
    top_words: int = TOP_WORDS,
    tails: int = TAIL_BUCKETS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Learns from the documents outside the held-out fold and scores every one. Returns id_col,
    held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one), score (the model's)."""
    from pyspark.sql.pandas.types import to_arrow_type

    train_fold = crc_bucket(id_col, folds) != held_out
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), train_fold.alias("train"))
    id_field = rows.schema["id"].dataType
    id_type = to_arrow_type(id_field)

    words = rows.filter("train").select("text").mapInArrow(_count_map, "word binary, n long")
    vocabulary = written(spark, words.groupBy("word").agg(F.sum("n").alias("n")), "lm-vocabulary")
    n_tokens, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    n_end = (vocabulary.filter(F.octet_length("word") == 0).head() or {"n": 0})["n"]
    top = vocabulary.filter(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(top_words).collect()
    names = [bytes(r["word"]) for r in top]
    buckets = spark.sparkContext.broadcast(Buckets({w: k + 1 for k, w in enumerate(names)}, tails))
    own = buckets.value.own

    known = np.array([n_end, *[r["n"] for r in top]], np.int64)
    tokens, distinct = np.concatenate((known, np.zeros(tails, np.int64))), np.concatenate((np.ones(own, np.int64), np.zeros(tails, np.int64)))
    sums = vocabulary.filter(F.octet_length("word") > 0).mapInArrow(_tail_map(tails), "tail long, tokens long, words long").groupBy("tail").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    for r in sums.collect():  # a row per tail; of all words, so those with buckets of their own go again
        tokens[own + r["tail"]], distinct[own + r["tail"]] = r["tokens"], r["words"]
    np.subtract.at(tokens, own + word_tails(names, tails).astype(np.int64), known[1:])
    np.subtract.at(distinct, own + word_tails(names, tails).astype(np.int64), 1)
    # a bucket of one word has no room for unseen ones; shared buckets keep 1 for them
    room = np.log10(np.maximum(1.0, tokens + distinct + (np.arange(own + tails) >= own)))
    weight = (tokens + 1) / (tokens + 1).sum()

    fields = [("piece", T.LongType()), ("train", T.BooleanType()), ("ids", T.ArrayType(id_field)), ("active", T.BinaryType()), ("symbols", T.BinaryType()), ("rare", T.BinaryType()), ("word", T.BinaryType()), ("local", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    coded = written(spark, rows.mapInArrow(_code_map(buckets, schema.names, id_type), schema), "lm-coded")
    model = train(spark, coded.filter("train").select("active", "symbols"), buckets, weight, states, rounds)

    listed = coded.filter("word is not null").select(F.col("piece").alias("of"), "local", "word")
    counted = listed.join(vocabulary, "word", "left").select("of", "local", F.coalesce("n", F.lit(0)).cast("long").alias("c"))
    blocks = coded.filter("active is not null").select("piece", "train", "ids", "active", "symbols", "rare")
    out = [("id", id_field), ("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    result = T.StructType([T.StructField(n, t) for n, t in out])
    whole = float(np.log10(n_tokens + n_distinct + 1))
    share = spark.sparkContext.broadcast
    scored = blocks.groupBy("piece").cogroup(counted.groupBy("of")).applyInArrow(_score_map(share(model), buckets, share((known, room)), whole, result.names, id_type), result)
    return scored.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
