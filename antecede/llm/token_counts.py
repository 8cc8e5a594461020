"""Operator 1: token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
boundary that both have and that is proven stable: a place beside white space which no pre-token of
the tokenizer can span, with the same tokens at the same offsets on both sides of it in both
chunks. Where the overlap has no such place it is doubled, and in the end the chunks become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from antecede.llm.common import mapped, slices
from antecede.llm.encoding import ODD_FOR_WORDS, Encoder, encoder

#: Characters of a chunk; texts up to this length are encoded in one piece.
CHUNK = 32_768
#: Characters that a chunk shares with the one before it, at first.
OVERLAP = 256
#: Tokens that must agree on each side of a boundary.
AGREE = 4


def stable(drops_space: bool, text: str, at: int) -> bool:
    """Whether no pre-token spans the place before character `at`."""
    if at < 2 or at + 1 >= len(text):
        return False
    if drops_space:
        return text[at - 1] in " \n\t\r" and not text[at].isspace()
    return text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def spliced(coder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of a whole text, in runs."""
    drops = coder.odd is ODD_FOR_WORDS

    def encode(a: int, b: int) -> tuple[list[int], list[int]]:
        e = coder.library.encode(text[a:b], add_special_tokens=False)
        return e.ids, [a + x[0] for x in e.offsets]

    begin, end = 0, min(chunk, len(text))
    ids, at = encode(begin, end)
    while end < len(text):
        width = overlap
        while True:
            start = end - width
            if start <= begin:  # no boundary in the whole chunk: make it longer
                end = min(len(text), begin + 2 * (end - begin))
                ids, at = encode(begin, end)
                break
            further = min(len(text), start + max(chunk, 2 * width))
            next_ids, next_at = encode(start, further)
            cut = common(drops, text, ids, at, next_ids, next_at, start, end)
            if cut:
                i, j = cut
                yield ids[:i]
                ids, at, begin, end = next_ids[j:], next_at[j:], next_at[j], further
                break
            width *= 2
    yield ids


def common(drops: bool, text: str, ids: list[int], at: list[int], next_ids: list[int], next_at: list[int], start: int, end: int) -> tuple[int, int] | None:
    """Indexes, in both chunks, of the token after a common stable boundary as near as can be to the overlap's middle."""
    place = {x: j for j, x in reversed(list(enumerate(next_at))) if x < end}
    found = []
    for i in range(len(at) - AGREE, AGREE - 1, -1):
        if at[i] <= start:
            break
        j = place.get(at[i], -1)
        if j < AGREE or at[i] == at[i - 1] or not stable(drops, text, at[i]):
            continue
        near, far = slice(i - AGREE, i + AGREE), slice(j - AGREE, j + AGREE)
        if ids[near] == next_ids[far] and at[near] == next_at[far] and len(ids[near]) == 2 * AGREE:
            found.append((i, j))
    return min(found, key=lambda x: abs(2 * at[x[0]] - start - end), default=None)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of `docs`, in no order.

    A null text counts as empty and has 0 bytes and tokens; a null doc_id stays null; repeated rows
    are counted each. Other columns are not read. `tokenizer` is a path that every executor has: a
    `.json` of the tokenizers library, or a `.model` of sentencepiece, which is encoded in one piece.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            count = lambda texts: [len(model.encode(x)) for x in texts]
        else:
            coder = encoder(tokenizer)

            def count(texts: list[str]) -> list[int]:
                whole = iter(coder.batch([x for x in texts if len(x) <= chunk or coder.odd is None]))
                return [len(next(whole)) // 4 if len(x) <= chunk or coder.odd is None else sum(map(len, spliced(coder, x, chunk, overlap))) for x in texts]

        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = count(texts)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            )

    return mapped(docs.select("doc_id", "text"), counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "counts")
