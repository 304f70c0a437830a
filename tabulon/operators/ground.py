"""Grounding: where in a document's pages a quote stands."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import fold_text, fold_token

LEAST, ENOUGH = 85.0, 99.5
#: Letters of pages that are searched at once, and stretches that are scored before common letters are counted.
LETTERS_HELD, FIRST_SCORED = 1 << 17, 16


def folded(words: str) -> F.Column:
    return F.filter(F.transform(F.col(words), lambda w: fold_token(w)), lambda w: w != "")


def best_window(quote: str, page: str) -> tuple[float, int, int]:
    """Indel ratio (0 to 100) of the quote and the stretch of the page of its length that is most alike, and where that is.

    Stretches begin at any character, and are shorter at both ends of the page; of equal ones the first counts. The number of common
    letters bounds a ratio from above: stretches that cannot reach LEAST are not scored, the others from the highest bound on.
    """
    n, size = len(quote), len(page)
    if not n or not page:
        return 0.0, 0, 0
    at = page.find(quote)
    if at >= 0:
        return 100.0, at, at + n
    codes = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.arange(1 - n, size)
    begin, end = np.maximum(places, 0), np.minimum(places + n, size)
    common, masks = np.zeros(len(places), np.int64), {}
    for c, k in Counter(quote).items():
        seen = np.concatenate([[0], np.cumsum(codes == ord(c))])
        common += np.minimum(k, seen[end] - seen[begin])
        masks[c] = sum(1 << i for i, x in enumerate(quote) if x == c)
    bounds = 200 * common / (n + end - begin)
    maybe = np.flatnonzero(bounds >= LEAST)
    best, first, full = (0.0, 0, 0), size, (1 << n) - 1
    for i in maybe[np.argsort(-bounds[maybe], kind="stable")]:
        if bounds[i] < best[0]:
            break
        a, b, row = int(begin[i]), int(end[i]), full
        for y in page[a:b]:  # the zeros of row count the longest common subsequence
            u = row & masks.get(y, 0)
            row = ((row + u) | (row - u)) & full
        ratio = 200 * (n - row.bit_count()) / (n + b - a)
        if ratio > best[0] or (ratio == best[0] and i < first):
            best, first = (ratio, a, b), int(i)
    return best


class Stretches:
    """The stretches of some pages, none of them empty, that a quote is compared with, and bounds of how alike they can be.

    Pages are laid out in one text, with one letter less than the quote's between them, of a kind that the quote hasn't. So every place of that
    text is one stretch of one page, what a stretch holds is the difference of two running totals, and the order of places is that of the pages.
    """

    def __init__(self, quote: str, pages: list[str]) -> None:
        self.quote, n = quote, len(quote)
        gap = next(c for c in map(chr, range(n + 1)) if c not in quote) * (n - 1)
        self.text = gap.join(["", *pages, ""])
        codes, own = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (self.text, quote))
        letters = np.unique(own)
        number = np.zeros(max(int(codes.max(initial=0)), int(letters[-1])) + 1, np.int32)
        number[letters] = np.arange(1, len(letters) + 1)
        self.ids, self.own = number[codes], number[own]
        sizes = np.array([len(p) for p in pages])
        self.ends = np.cumsum(sizes + n - 1)
        self.begins = self.ends - sizes
        edge = np.zeros(len(codes) + 1, np.int32)
        edge[self.begins] += 1
        edge[self.ends] -= 1
        self.sizes = self._within(np.cumsum(edge[:-1], dtype=np.int32), n)
        self.both = self.sizes + n
        self.masks: dict[str, int] = {}
        for i, x in enumerate(quote):
            self.masks[x] = self.masks.get(x, 0) | 1 << i
        self.top = (0.0, 1, 0.0, 0)

    @staticmethod
    def _within(counts: np.ndarray, n: int) -> np.ndarray:
        """What is counted in each n neighbours."""
        total = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=total[1:])
        return total[n:] - total[: len(total) - n]

    def by_pairs(self) -> np.ndarray:
        """The most letters that each stretch can have in common with the quote, by pairs of neighbours.

        Each letter of the quote that a common subsequence leaves out breaks up two of its pairs of neighbours at most, each letter of the stretch
        between them one. So a stretch with L common letters has 3 L - (both lengths) - 1 pairs of the quote at least; few stretches elsewhere on
        a page have so many.
        """
        base = int(self.own.max()) + 1
        held = np.zeros(base * base, np.uint8)
        held[self.own[:-1] * base + self.own[1:]] = 1
        pairs = self._within(held[self.ids[:-1] * base + self.ids[1:]], len(self.quote) - 1)
        return np.minimum((pairs + self.both + 1) // 3, self.sizes)

    def by_letters(self) -> np.ndarray:
        """The same by how often each letter occurs."""
        common = np.zeros(len(self.both), np.int32)
        for k, times in enumerate(np.bincount(self.own)):
            if times:
                common += np.minimum(times, self._within(self.ids == k, len(self.quote)))
        return common

    def ratio(self, first: int, end: int) -> float:
        """Indel ratio (0 to 100) of the quote and these letters of the text."""
        n, row, full = len(self.quote), (1 << len(self.quote)) - 1, (1 << len(self.quote)) - 1
        for y in self.text[first:end]:  # the zeros of row count the longest common subsequence
            u = row & self.masks.get(y, 0)
            row = ((row + u) | (row - u)) & full
        return 200 * (n - row.bit_count()) / (n + end - first)

    def score(self, places: np.ndarray, bounds: np.ndarray, least: float) -> None:
        """Finds the best place, from the highest bound on, as long as a bound reaches `least` and what is best so far.

        As page by page: a page that has ENOUGH comes before all later ones, else the higher ratio counts; of equals the first.
        """
        begins, ends = self.begins.tolist(), self.ends.tolist()
        order = np.argsort(-bounds, kind="stable")
        for place, bound in zip(places[order].tolist(), bounds[order].tolist(), strict=True):
            if bound < max(least, self.top[0]):
                break
            page = bisect_right(ends, place)
            if (min(bound, ENOUGH), -page, bound, -place) > self.top:
                ratio = self.ratio(max(place, begins[page]), min(place + len(self.quote), ends[page]))
                self.top = max(self.top, (min(ratio, ENOUGH), -page, ratio, -place))

    def best(self, above: float) -> tuple[float, int, int, int]:
        """(ratio, page, first, end letter) of the best place, if that is more than `above`; else 0."""
        _, page, ratio, place = self.top
        if ratio <= above:
            return 0.0, 0, 0, 0
        page, place = -page, -place
        begin, end = int(self.begins[page]), int(self.ends[page])
        return ratio, page, max(place - begin, 0), min(place + len(self.quote), end) - begin


def alike(quote: str, pages: list[str], above: float = 0.0) -> tuple[float, int, int, int]:
    """(ratio, page, first, end letter) as best_window finds it page by page, if that is LEAST at least and more than `above`; else 0. No page holds the quote as it is."""
    held, least = Stretches(quote, pages), max(LEAST, above)
    most = held.by_pairs()
    maybe = np.flatnonzero((200 * most >= LEAST * held.both) & (200 * most > above * held.both))
    bounds = 200 * most[maybe] / held.both[maybe]
    if len(maybe) > FIRST_SCORED:
        some = np.argsort(-bounds, kind="stable")[:FIRST_SCORED]
        held.score(maybe[some], bounds[some], least)
        rest = bounds >= max(least, held.top[0])
        rest[some] = False
        maybe = maybe[rest]
        bounds = 200 * np.minimum(most, held.by_letters())[maybe] / held.both[maybe] if len(maybe) else bounds[rest]
    held.score(maybe, bounds, least)
    best = held.best(above)
    return best if best[0] >= LEAST else (0.0, 0, 0, 0)


def less_alike(quote: str, pages: list[str], above: float = 0.0) -> tuple[float, int, int, int]:
    """The same where no page has LEAST: of what best_window scores, since its letters could reach LEAST, the best, if that is more than `above`."""
    held = Stretches(quote, pages)
    common = held.by_letters()
    maybe = np.flatnonzero(200 * common >= LEAST * held.both)
    held.score(maybe, 200 * np.minimum(common, held.by_pairs())[maybe] / held.both[maybe], above)
    return held.best(above)


def runs(pages: list[str], gap: int) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring pages, of LETTERS_HELD letters with gaps or one page, with the number of the first; empty ones end a run and are left out."""
    held, letters = [], 0
    for i, text in enumerate(pages):
        if held and (not text or letters + len(text) + gap > LETTERS_HELD):
            yield i - len(held), held
            held, letters = [], 0
        if text:
            held.append(text)
            letters += len(text) + gap
    if held:
        yield len(pages) - len(held), held


def search(quote: str, pages: list[tuple[int, str]]) -> tuple[float, int | None, int, int]:
    """(score, page, first, end letter) of the best page, of equals the first; one of ENOUGH ends the search.

    A page that holds the quote as it is, is found first: a page before it counts only from ENOUGH on, which a short quote can't reach in part.
    Only if no page has LEAST the best of what is less is looked for.
    """
    n, texts = len(quote), [text for _, text in pages]
    whole = next((i for i, text in enumerate(texts) if quote in text), None)
    if whole is not None:
        if 200 * (n - 1) / (2 * n - 1) >= ENOUGH:
            for i, some in runs(texts[:whole], n):
                score, k, a, b = alike(quote, some)
                if score >= ENOUGH:
                    return score, pages[i + k][0], a, b
        at = texts[whole].find(quote)
        return 100.0, pages[whole][0], at, at + n
    for way in (alike, less_alike):
        best: tuple = (0.0, None, 0, 0)
        for i, some in runs(texts, n):
            score, k, a, b = way(quote, some, best[0])
            if score > best[0]:
                best = (score, pages[i + k][0], a, b)
            if best[0] >= ENOUGH:
                break
        if best[0] >= LEAST:
            break
    return best


def words_of(text: str, lengths: list[int] | None, first: int, end: int) -> tuple[int | None, int | None]:
    """First and end word of letters of a page; its words are parted by blanks, or have these lengths."""
    if lengths is None:
        a, b = text.count(" ", 0, first + 1), text.count(" ", 0, max(end - 1, 0)) + 1
        return (a, b) if a < b else (None, None)
    a = b = None
    at = 0
    for k, length in enumerate(lengths):
        if at < end and first < at + length:
            a, b = (k if a is None else a), k + 1
        at += length + 1
    return a, b


def grounded(quote: str, cited: int | None, pages: list[tuple[float, str, list[int] | None]]) -> tuple:
    """match_score, match_page, word_start, word_end and failure of a folded quote."""
    if not quote:
        return 0.0, None, None, None, "no_quote"
    if not any(text for _, text, _ in pages):
        return 0.0, None, None, None, "no_text_layer"
    far = lambda k: 2 if cited is None else min(2, abs(k - cited))
    placed = sorted(pages, key=lambda x: (far(x[0]), x[0]))
    score, at, i, j = search(quote, [(k, text) for k, (_, text, _) in enumerate(placed)])
    if score < LEAST:
        return round(score, 1), None, None, None, "page_out_of_range" if cited is not None and cited not in {k for k, _, _ in pages} else "quote_not_found"
    page, text, lengths = placed[at]
    return round(score, 1), None if page == math.inf else page, *words_of(text, lengths, i, j), None


def ground(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """fields (document_id, field_key, quote, page_index) with pages (document_id, page_index, words array<string>).

    Adds match_score (one decimal), match_page, word_start, word_end and failure. The cited page comes first, then its neighbours, then
    the rest; a page replaces the best so far only if it is strictly better, and a full match ends the search. Rows of a document, pages first,
    stand together in one task, which reads them in batches and holds the pages of one document; a document has some dozen fields.
    """
    kind = dict(fields.dtypes)["document_id"]
    plain = F.array_join("words", " ")
    odd = F.exists("words", lambda w: F.contains(w, F.lit(" ")))  # a word of its own with a blank in it
    sheets = pages.select(
        "document_id", F.lit(False).alias("is_quote"), F.lit(None).cast("string").alias("field_key"), F.col("page_index").cast("int").alias("page_index"),
        F.when(odd, F.array_join(folded("words"), " ")).otherwise(F.coalesce(fold_text(plain), F.lit(""))).alias("text"),
        F.when(odd, F.transform(folded("words"), lambda w: F.length(w))).alias("lengths"),
    )
    quotes = fields.select(
        "document_id", F.lit(True).alias("is_quote"), "field_key", F.col("page_index").cast("int").alias("page_index"),
        fold_text(F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s+", " ")).alias("text"), F.lit(None).cast("array<int>").alias("lengths"),
    )
    kinds = {"match_score": pa.float64(), "match_page": pa.int32(), "word_start": pa.int32(), "word_end": pa.int32(), "failure": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, held = None, []
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("document_id", "is_quote", "page_index", "text", "lengths"))
            for d, is_quote, k, text, lengths in zip(*columns, strict=True):
                if d != document:
                    document, held = d, []
                if is_quote:
                    found.append(grounded(text, k, held))
                else:
                    held.append((math.inf if k is None else k, text, lengths))
            asked = batch.filter(batch.column("is_quote"))
            results = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [asked.column("document_id"), asked.column("field_key"), *[pa.array(r, t) for r, t in zip(results, kinds.values(), strict=True)]], ["document_id", "field_key", *kinds])

    dealt = sheets.unionByName(quotes).repartition("document_id").sortWithinPartitions("document_id", "is_quote")
    return dealt.mapInArrow(run, f"document_id {kind}, field_key string, match_score double, match_page int, word_start int, word_end int, failure string")
