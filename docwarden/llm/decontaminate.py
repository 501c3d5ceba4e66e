"""Benchmark decontamination: BM25 over test items, searched by every training passage.

The index holds test items. Every passage (a window of words of a training text, overlapping so
that any run as long as the longest item lies whole in one) is a query over its distinct terms.
Weights are BM25 weights divided by the item's score for itself, so a score is the share of the
item's weight that the passage covers, and one threshold fits all items.

Search is block-max WAND on arrays. An item's commonest terms, up to ``SLACK`` of its weight, are
never looked up at first; what they could add is part of every bound. Rarer terms are summed per
passage and block of items with the block's largest weights; only blocks whose bound reaches the
threshold are summed per item, and only items whose bound reaches it are scored in full. No item
that reaches the threshold is missed.

A hit counts if the passage also holds enough of the item's question and of its answer, as shares
of their word trigrams. Where an item is one text (``one_text``), its question and answer are only
parts cut from it, and a hit counts by the share of the trigrams of both together: a change in a
short last sentence, or a copy without it, costs no more than its words.

Texts stay in place: one pass with Arrow batches, no shuffle of texts or passages. The index is
sent to the executors in parts of at most ``PART_POSTINGS`` postings, one pass over the texts
each, so its size on an executor has a bound whatever the number of items.

Words of texts and items are compared without case, in every script: other than the operators
that fold A-Z only by contract, texts with other letters are folded as whole strings first.

Defined cases: null and empty texts match nothing; items with fewer than ``LEAST_WORDS`` words
match nothing; an item without an answer is judged by its question; repeated rows give repeated
results for each; empty tables give an empty table; rows with a null id keep it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.storage import bounded_batches, stored
from docwarden.llm.tokens import NOT_ALPHANUMERIC, Words, pieces, shingle_hashes, words

K1, B = 1.2, 0.75
#: Items of one block of the index.
BLOCK_ITEMS = 8
#: Share of an item's weight left to terms that are looked up last.
SLACK = 0.35
PART_POSTINGS = 1_000_000
LEAST_WORDS = 5
SHINGLE = 3


@dataclass
class Index:
    """Postings by term, per item and per block; ``ptr`` arrays say where a term's postings are."""

    items: list
    length: int  # words of the longest item
    vocab: np.ndarray
    item_ptr: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    block_ptr: np.ndarray
    block: np.ndarray
    block_weight: np.ndarray
    rest: np.ndarray  # per item, the weight of terms without postings
    terms: list  # per item, sorted hashes of all terms and their weights
    question: list
    answer: list


def folded_words(column: pa.Array) -> Words:
    """Words under full Unicode case folding; by way of upper case, so that ß and SS, ς and Σ or ı and I agree.
    Texts of ASCII only need no more than the fold of the word hashes."""
    other = pc.invert(pc.fill_null(pc.string_is_ascii(column), True)).to_numpy(zero_copy_only=False)
    if other.any():
        folded = [t.upper().casefold() for t in column.filter(pa.array(other)).to_pylist()]
        column = pc.replace_with_mask(column, pa.array(other), pa.array(folded, column.type))
    return words(column, NOT_ALPHANUMERIC)


def _ptr(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def build_index(ids: list, questions: list, answers: list, n_items: int, mean_words: float,
                seen_terms: np.ndarray, seen_in: np.ndarray) -> Index:
    """Index some items; ``seen_in`` counts the items of the whole benchmark with each term."""
    q = folded_words(pa.array(questions, pa.string()))
    a = folded_words(pa.array(answers, pa.string()))
    order = np.argsort(seen_terms)
    seen_terms, seen_in = seen_terms[order], seen_in[order]
    kept, terms, rest, post = [], [], [], []
    question, answer, longest = [], [], 1
    for i, item_id in enumerate(ids):
        both = np.concatenate([q.of(i), a.of(i)])
        if len(both) < LEAST_WORDS:
            continue
        term, tf = np.unique(both, return_counts=True)
        df = seen_in[np.searchsorted(seen_terms, term)]
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(both) / mean_words))
        w = w / w.sum()
        common = np.argsort(idf, kind="stable")
        slack = np.cumsum(w[common])
        late = common[slack <= SLACK]
        rare = np.ones(len(term), bool)
        rare[late] = False
        k = len(kept)
        kept.append(item_id)
        rest.append(float(w[late].sum()))
        terms.append((term, w))
        post.append((term[rare], np.full(rare.sum(), k), w[rare]))
        question.append(_shingles(q.of(i)))
        answer.append(_shingles(a.of(i)))
        longest = max(longest, len(both))
    t, i, w = (np.concatenate(x) if post else np.zeros(0, np.uint64) for x in (list(zip(*post)) or [[]] * 3))
    vocab, tid = np.unique(t, return_inverse=True)
    i, w = i.astype(np.int64), w.astype(float)
    order = np.lexsort((i, tid))
    tid, i, w = tid[order], i[order], w[order]
    key, first = np.unique(tid * (len(kept) + 1) + i // BLOCK_ITEMS, return_index=True)
    return Index(
        kept, longest, vocab, _ptr(tid, len(vocab)), i, w, _ptr(tid[first], len(vocab)),
        i[first] // BLOCK_ITEMS, np.maximum.reduceat(w, first) if len(w) else w, np.array(rest),
        terms, question, answer)


def _expand(ptr: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its postings: (which of the terms, place in the posting arrays)."""
    size = ptr[term + 1] - ptr[term]
    which = np.repeat(np.arange(len(term)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ptr[term], size)


def _sums(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(key, return_inverse=True)
    return found, np.bincount(at, w, len(found))


def candidates(index: Index, found: Words, threshold: float):
    """(row, first word, last word, item) of passages whose bound for an item reaches the threshold."""
    none = [np.zeros(0, np.int64)] * 4
    n_words = np.diff(found.row_ptr)
    if not len(index.items) or not len(found.hashes):
        return none
    at = np.minimum(np.searchsorted(index.vocab, found.hashes), len(index.vocab) - 1)
    hit = np.flatnonzero(index.vocab[at] == found.hashes)
    step = index.length
    row = np.searchsorted(found.row_ptr, hit, "right") - 1
    n_windows = np.maximum(1, -(-n_words // step) - 1)
    base = np.concatenate([[0], np.cumsum(n_windows)])
    segment = (hit - found.row_ptr[row]) // step
    own = np.minimum(segment, n_windows[row] - 1)
    before = (segment > 0) & (segment - 1 < own)
    window = np.concatenate([base[row] + own, (base[row] + segment - 1)[before]])
    n_terms = len(index.vocab)
    pair = np.unique(window * n_terms + np.concatenate([at[hit], at[hit][before]]))
    window, term = pair // n_terms, pair % n_terms

    n_blocks = -(-len(index.items) // BLOCK_ITEMS)
    rest = np.zeros(n_blocks)
    np.maximum.at(rest, np.arange(len(index.items)) // BLOCK_ITEMS, index.rest)
    which, place = _expand(index.block_ptr, term)
    key = window[which] * n_blocks + index.block[place]
    blocks, bound = _sums(key, index.block_weight[place])
    blocks = blocks[bound + rest[blocks % n_blocks] >= threshold]
    if not len(blocks):
        return none

    use = np.isin(window, blocks // n_blocks)
    window, term = window[use], term[use]
    which, place = _expand(index.item_ptr, term)
    item = index.item[place]
    near = np.isin(window[which] * n_blocks + item // BLOCK_ITEMS, blocks)
    key, score = _sums(window[which][near] * len(index.items) + item[near], index.weight[place][near])
    item = key % len(index.items)
    ok = score + index.rest[item] >= threshold
    window, item = key[ok] // len(index.items), item[ok]
    row = np.searchsorted(base, window, "right") - 1
    first = found.row_ptr[row] + (window - base[row]) * step
    return row, first, np.minimum(first + 2 * step, found.row_ptr[row + 1]), item


def _shingles(text: np.ndarray) -> tuple[int, np.ndarray]:
    """Distinct shingles and their length, which is less than SHINGLE for shorter texts."""
    return min(SHINGLE, len(text)), np.unique(shingle_hashes(text, SHINGLE))


def _share(wanted: tuple[int, np.ndarray], passage: np.ndarray) -> float:
    size, shingles = wanted
    return float(np.isin(shingles, shingle_hashes(passage, size)).mean()) if size else 1.0


def matches(index: Index, found: Words, threshold: float, overlap: float, one_text: bool = False) -> dict:
    """Best (score, question share, answer share, first word) by (row, item)."""
    best: dict = {}
    for row, lo, hi, k in zip(*candidates(index, found, threshold), strict=True):
        passage = found.hashes[lo:hi]
        term, w = index.terms[k]
        score = float(w[np.isin(term, passage)].sum())
        if score < threshold:
            continue
        question, answer = _share(index.question[k], passage), _share(index.answer[k], passage)
        n, m = len(index.question[k][1]), len(index.answer[k][1])
        if n * question + m * answer >= overlap * (n + m) - 1e-9 if one_text else min(question, answer) >= overlap:
            best[row, k] = max(best.get((row, k), (0.0,)), (score, question, answer, int(lo - found.row_ptr[row])))
    return best


def _search(part, threshold: float, overlap: float, one_text: bool):
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        index = part.value
        for batch in batches:
            for piece in pieces(batch, 1):
                found = matches(index, folded_words(piece.column(1)), threshold, overlap, one_text)
                if found:
                    ids = piece.column(0).to_pylist()
                    rows = [(ids[r], index.items[k], *v) for (r, k), v in sorted(found.items())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def split_item(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item that is one text: the answer is its last sentence, or the
    last third of its words where there is only one sentence."""
    text = F.coalesce(F.trim(text), F.lit(""))
    last = F.regexp_extract(text, r"(?s)[.?!]\s+([^.?!]+[.?!]*)$", 1)
    parts = F.split(text, r"\s+")
    third = F.greatest(F.lit(1), F.floor(F.size(parts) / 3)).cast("int")
    tail = F.array_join(F.slice(parts, F.size(parts) - third + 1, third), " ")
    head = F.array_join(F.slice(parts, 1, F.size(parts) - third), " ")
    has = F.length(last) > 0
    question = F.when(has, F.substring(text, F.lit(1), F.length(text) - F.length(last))).otherwise(head)
    return question, F.when(has, last).otherwise(tail)


def _terms_of(batches):
    for batch in batches:
        found = folded_words(batch.column(0))
        n = np.diff(found.row_ptr)
        row = np.repeat(np.arange(len(n)), n)
        pair = np.unique(np.stack([row.astype(np.uint64), found.hashes], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].copy().view(np.int64)), pa.array(n[pair[:, 0].astype(int)])], ["term", "n"])


def contaminated(
    docs: DataFrame, items: DataFrame, *, question: Column, answer: Column, doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", threshold: float = 0.6, overlap: float = 0.7,
    one_text: bool = False,
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, first_word`` of every hit.

    ``question`` and ``answer`` are columns of ``items``; ``one_text`` says that they are parts of one
    text, whose overlap is judged as a whole, and not a question with an answer of its own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    given = stored(items.select(
        F.col(f"`{item_id}`").cast("long").alias("item_id"), F.coalesce(question, F.lit("")).alias("q"),
        F.coalesce(answer, F.lit("")).alias("a")))
    whole = given.select(F.concat_ws(" ", "q", "a").alias("t"))
    terms = stored(whole.mapInArrow(_terms_of, "term long, n long"))
    n_items = given.count()
    seen = stored(terms.groupBy("term").agg(F.count("*").alias("df")))
    n_postings = terms.count()
    length = whole.agg(F.avg(F.size(F.split("t", r"\s+")))).first()[0] or 1.0
    parts = max(1, -(-n_postings // PART_POSTINGS))
    found = None
    for p in range(parts):
        own = given.where(F.pmod(F.xxhash64("item_id", "q"), F.lit(parts)) == p).orderBy("item_id", "q", "a")
        rows = own.collect()
        mine = whole if parts == 1 else own.select(F.concat_ws(" ", "q", "a").alias("t"))
        known = seen.join(mine.mapInArrow(_terms_of, "term long, n long").select("term").distinct(), "term").toArrow()
        index = build_index(
            [r.item_id for r in rows], [r.q for r in rows], [r.a for r in rows], n_items, length,
            known.column("term").to_numpy().view(np.uint64), known.column("df").to_numpy())
        hits = texts.mapInArrow(
            _search(spark.sparkContext.broadcast(index), threshold, overlap, one_text),
            "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        found = hits if found is None else found.unionByName(hits)
    return found
