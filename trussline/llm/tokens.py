"""Token counts with a whole-token shortcut, for a sentencepiece BPE model with byte fallback.

The model's pieces have the word mark (U+2581) at their start only, so no merge crosses from a word
into the blank after it: a text is a sequence of pre-tokens, each a run of blanks and the word that
follows, and its token count is the sum of theirs.  `whole_tokens` proves which vocabulary strings
encode alone as one token; pre-tokens among them count one without any merging, and only the rest is
given to the library, each distinct string once a batch.

`WordCounter` checks the premise on the model it is given and refuses another kind of model.

Defined cases: null and empty texts have 0 tokens; texts of blanks only, very long words and special
strings such as "<s>" inside a text are counted as the library counts them; repeated rows and extra
columns pass, but for columns with the result's own names, which are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
OVER = 4096
#: Distinct merged strings a task remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
_PRE = re.compile(" +[^ ]*")


def whole_tokens(processor: sentencepiece.SentencePieceProcessor) -> set[str]:
    """Vocabulary strings, as pre-tokens with a blank for the mark, that encode alone as one token."""
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    marked = [n.replace(MARK, " ") for n in names if n.startswith(MARK)]
    alone = processor.encode([m[1:] for m in marked], num_threads=1)
    whole = {m for m, ids in zip(marked, alone, strict=True) if len(ids) == 1}
    # a lone blank cannot be encoded alone (the library adds one); it is the mark's own piece, if there is one
    return whole | {" "} if MARK in names else whole


class WordCounter:
    def __init__(self, model_file: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        crosses = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        if crosses or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix:
            raise ValueError("pre-tokens of this model cannot be counted one by one")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.whole = dict.fromkeys(whole_tokens(self.processor), 1)
        self.known = dict(self.whole)

    def counts(self, texts: list[str | None]) -> list[int]:
        pre = [self._split(t) if t else [] for t in texts]
        known = self.known
        rest = list({w for words in pre for w in words if w not in known})
        if len(known) + len(rest) > REMEMBERED:
            known = self.known = dict(self.whole)
            rest = list({w for words in pre for w in words if w not in known})
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            known.update(zip(part, map(len, self.processor.encode([w[1:] for w in part], num_threads=1)), strict=True))
        return [sum(map(known.__getitem__, words)) for words in pre]

    @staticmethod
    def _split(text: str) -> list[str]:
        return _PRE.findall(" " + text.replace(MARK, " "))


def with_counts(docs: DataFrame, text: str = "text", model: str = MODEL, over: int = OVER) -> DataFrame:
    """`docs` with _n_bytes, _n_tokens and _over_limit of the whole `text`; earlier columns of these names are replaced."""
    added = [T.StructField("_n_bytes", T.LongType()), T.StructField("_n_tokens", T.LongType()), T.StructField("_over_limit", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))
    at = docs.columns.index(text)

    def batches(it):
        counter = WordCounter(public_tokenizers.path(model))
        for whole in it:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = batch.column(at)
                n = counter.counts(texts.to_pylist())
                sizes = [len(t) if t else 0 for t in texts.cast(pa.binary()).to_pylist()]
                cols = [pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > over for x in n])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *added]))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_counts(docs).select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"), F.col("_over_limit").alias("over_limit"))
