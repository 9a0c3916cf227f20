"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled into a deterministic transducer over bytes. BPE has
the property that a sequence of tokens is the encoding of its text exactly if
each two neighbours are the encoding of theirs. So after reading a prefix, all
that the future depends on is, for every start from which some token may still
grow, how far that token has grown, which token ends there, and how many tokens
fewer than now have been emitted there. Such a set is a state; reading a byte
leads to one other state and emits a number of tokens, which is noted on the
transition. States are compiled when first reached and shared by all words. The
last byte of a pre-token is a symbol of its own that leads back to the start.

A text is read in chunks, each of which becomes a state map, entry state -> (exit
state, tokens emitted), without knowing what came before. White space leads back
to the start, so a run of pieces that ends there has the start as its one entry;
counts of short pieces are remembered. A piece of more than `chunk` bytes is cut at
fixed places, wherever they fall in a pre-token: the entries of such a chunk are the
states that several lengths of text before the cut lead to, as a rule the true one
among them, because the sets forget what lies further back than a token is long.
Maps compose associatively, and a scan that combines neighbours in rounds, as
parallel prefix scans do, gives the count of the whole text; where it meets an entry
that a map does not have, the chunk is read from there as well, so counts are exact.

The compiled states are bounded: beyond most_states they are dropped at the next
chunk or pre-token. A state in a map is the set itself, which no dropping changes.

Null and empty texts count 0, very long ones are read in chunks, an empty table
gives no row. Every row gives one row, repeated ids and texts too. No other column
of the input is read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .word_bpe import Remembered, WordVocabulary, latin_word, pieces, runs

START = 0
#: A live start: (node of the tree, token that ends at the start, tokens emitted there less those emitted now).
State = frozenset
BEGIN: State = frozenset({(0, "", 0)})
#: Bytes of text before a chunk that lead to its entries.
BEFORE = (6, 24, 96)


class StateMap(dict):
    """entry state -> (exit state, tokens emitted). read: gives the value of an entry that is not there yet."""

    def __init__(self, known: dict[State, tuple[State, int]], read: Callable[[State], tuple[State, int]] | None = None):
        super().__init__(known)
        self.read = read

    def __missing__(self, entry: State) -> tuple[State, int]:
        if self.read is None:
            raise KeyError(entry)
        value = self[entry] = self.read(entry)
        return value


def compose(first: StateMap, then: StateMap) -> StateMap:
    """The map of reading one chunk after the other."""

    def onward(value: tuple[State, int]) -> tuple[State, int]:
        leave, more = then[value[0]]
        return leave, value[1] + more

    return StateMap({entry: onward(value) for entry, value in first.items()}, lambda entry: onward(first[entry]))


def scan(maps: list[StateMap]) -> list[StateMap]:
    """Inclusive prefix composition in a logarithmic number of rounds."""
    maps, step = list(maps), 1
    while step < len(maps):
        maps = maps[:step] + [compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
        step *= 2
    return maps


class Transducer:
    """Deterministic, compiled as it is used; transitions carry emitted counts.

    most_states bounds the memory: beyond it the compiled part is dropped and
    grows anew, which changes no count.
    """

    def __init__(self, vocabulary: WordVocabulary, most_states: int = 400_000):
        self.vocabulary, self.most = vocabulary, most_states
        self.tree: dict[tuple[int, str], int] = {}
        self.token_at: dict[int, str] = {}
        made = {a + b for a, b in vocabulary.ranks} | {s + e for s in vocabulary.symbols for e in ("", vocabulary.end)}
        nodes = 1
        for token in made:
            node = 0
            for symbol in self.symbols_of(token):
                to = self.tree.get((node, symbol))
                if to is None:
                    to = self.tree[node, symbol] = nodes
                    nodes += 1
                node = to
            self.token_at[node] = token
        self.inner = {node for node, _ in self.tree}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.live, self.moves = {BEGIN: START}, [BEGIN], {}

    def symbols_of(self, token: str) -> list[str]:
        end = self.vocabulary.end
        if token.endswith(end) and len(token) > len(end):
            body = token[: -len(end)]
            return [*body[:-1], body[-1] + end]
        return list(token)

    def fits(self, left: str, token: str) -> bool:
        """Whether left, token is how their joint text is encoded."""
        if (alone := self.whole.get(token)) is None:
            alone = self.whole[token] = self.vocabulary.merge(self.symbols_of(token)) == [token]
        if not left or not alone:
            return alone
        if (known := self.pairs.get((left, token))) is None:
            if len(self.pairs) > 4 * self.most:
                self.pairs.clear()
            known = self.pairs[left, token] = self.vocabulary.merge(self.symbols_of(left) + self.symbols_of(token)) == [left, token]
        return known

    def compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition from state on symbol: next state and tokens emitted."""
        grown = [(to, left, behind) for node, left, behind in self.live[state] if (to := self.tree.get((node, symbol))) is not None]
        # one encoding ends here, so the first that fits is the only one
        end = next(((self.token_at[node], behind + 1) for node, left, behind in grown if node in self.token_at and self.fits(left, self.token_at[node])), None)
        if end is None:
            raise ValueError(f"the vocabulary has no encoding that ends at {symbol!r}")
        last, emitted = end
        if symbol.endswith(self.vocabulary.end) and len(symbol) > 1:
            move = (START, emitted)
        else:
            then = frozenset({(node, left, behind - emitted) for node, left, behind in grown if node in self.inner} | {(0, last, 0)})
            to = self.states.get(then)
            if to is None:
                to = self.states[then] = len(self.live)
                self.live.append(then)
            move = (to, emitted)
        self.moves[state, symbol] = move
        return move

    def read(self, symbols: list[str], state: int = START) -> tuple[int, int]:
        """Run over symbols: state reached, tokens emitted."""
        if state == START and len(self.live) > self.most:
            self.reset()
        moves, count = self.moves, 0
        for symbol in symbols:
            move = moves.get((state, symbol)) or self.compile(state, symbol)
            state = move[0]
            count += move[1]
        return state, count

    def read_from(self, entry: State, symbols: list[str]) -> tuple[State, int]:
        """The same between states as sets, which stay what they are when the compiled ones are dropped."""
        if len(self.live) > self.most:
            self.reset()
        at = self.states.get(entry)
        if at is None:
            at = self.states[entry] = len(self.live)
            self.live.append(entry)
        leave, count = self.read(symbols, at)
        return self.live[leave], count


class TokenCounter:
    """Counts of whole texts. chunk: bytes of a chunk within a piece; run: short pieces in a chunk."""

    def __init__(self, path: str, most_remembered: int = 400_000, chunk: int = 4096, run: int = 65_536, most_states: int = 400_000):
        self.vocabulary = WordVocabulary(path)
        self.transducer = Transducer(self.vocabulary, most_states)
        self.words = Remembered(self._word, most_remembered)
        self.known = Remembered(self._piece, most_remembered)
        self.chunk, self.run = chunk, run

    def _word(self, pre_token: str) -> int:
        return self.transducer.read(self.vocabulary.spell(pre_token))[1]

    def _piece(self, piece: str) -> int:
        body = latin_word(piece)
        if body:
            return self.words[body] + (self.words[piece[len(body) :]] if len(body) < len(piece) else 0)
        return sum(map(self.words.__getitem__, self.vocabulary.cut(piece)))

    def _chunks(self, piece: str) -> Iterator[StateMap]:
        """The maps of a long piece, cut at fixed counts of bytes."""
        symbols = [x for pre_token in self.vocabulary.cut(piece) for x in self.vocabulary.spell(pre_token)]
        read = self.transducer.read_from
        for at in range(0, len(symbols), self.chunk):
            part = symbols[at : at + self.chunk]
            entries = {read(BEGIN, symbols[max(0, at - n) : at])[0] for n in BEFORE} if at else {BEGIN}
            yield StateMap({entry: read(entry, part) for entry in entries}, lambda entry, part=part: read(entry, part))

    def state_maps(self, text: str) -> Iterator[StateMap]:
        for special, part in runs(self.vocabulary, text):
            if special is not None:
                yield StateMap({BEGIN: (BEGIN, 1)})
                continue
            cut = pieces(self.vocabulary.normalise(part))
            for i in range(0, len(cut), self.run):
                short = cut[i : i + self.run]
                if max(map(len, short)) > self.chunk:
                    for piece in short:
                        if len(piece) > self.chunk:
                            yield from self._chunks(piece)
                    short = [piece for piece in short if len(piece) <= self.chunk]
                yield StateMap({BEGIN: (BEGIN, sum(map(self.known.__getitem__, short)))})

    def count(self, text: str) -> int:
        maps = scan(list(self.state_maps(text)))
        return maps[-1][BEGIN][1] if maps else 0


@lru_cache(1)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary: a file name of the public tokenizers, or a path.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))
        for batch in batches:
            texts = batch.column(1)
            size = pa.compute.coalesce(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = [counter.count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return rows.mapInArrow(count, f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
