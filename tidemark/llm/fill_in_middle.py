"""Fill-in-the-middle texts by displacement: every byte is moved by a running sum of shifts, and moved back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bytes_of, in_chunks

SEED = 7
RATE = 100
SPM_RATE = 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
WINDOW = 1 << 20


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit draws of each id, from the SHA-256 of `seed:id`; zeros for a null id."""
    digests = b"".join(
        bytes(16) if i is None else hashlib.sha256(f"{seed}:{i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def marks_in(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """First bytes of every `<P>`, `<S>` and `<M>` that lies inside one text."""
    found = []
    open_at = np.flatnonzero(data == PREFIX[0])
    last = at[np.searchsorted(at, open_at, side="right")] if len(open_at) else open_at
    open_at = open_at[open_at + MARK <= last]
    closed = open_at[data[open_at + 2] == PREFIX[2]]
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found.append(closed[data[closed + 1] == mark[1]])
    return found


def counted(sorted_at: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted positions lie in each text, and how many before it."""
    before = np.searchsorted(sorted_at, at)
    return np.diff(before), before[:-1]


def unit_end(lines: np.ndarray, before: np.ndarray, n_lines: np.ndarray, at: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Byte after the first `units` lines of each text; a last line without its newline ends with the text."""
    end = np.where(units > n_lines, at[1:], at[:-1])
    inside = (units > 0) & (units <= n_lines)
    end[inside] = lines[before[inside] + units[inside] - 1] + 1
    return end


def displace(data: np.ndarray, begin: np.ndarray, shift: np.ndarray, out: np.ndarray, gather: bool) -> None:
    """Move segments of `data`, which follow one another from `begin`, by `shift` bytes each.

    A difference array holds at each segment's first byte by how much the shift changes;
    its running sum is the shift of every byte. Scattered: `out[i + shift] = data[i]`.
    With `gather`, `out` is what is indexed by segments: `out[i] = data[i + shift]`.
    Windows of bounded size carry the running sum, so a long text needs no index of its own length.
    """
    change = np.diff(shift, prepend=0)
    n, carry = len(out) if gather else len(data), 0
    for first in range(0, n, WINDOW):
        last = min(n, first + WINDOW)
        lo, hi = np.searchsorted(begin, [first, last])
        delta = np.zeros(last - first, np.int64)
        np.add.at(delta, begin[lo:hi] - first, change[lo:hi])
        delta[0] += carry
        place = np.cumsum(delta, out=delta)
        carry = int(place[-1])
        place += np.arange(first, last)
        if gather:
            out[first:last] = data[place]
        else:
            out[place] = data[first:last]


def laid_out(sizes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where prefix, middle and suffix of each text lie in the output, where the marks lie, and where each output begins.

    `sizes` has the bytes of prefix, middle and suffix (a plain text is all prefix).
    """
    moved = form != PLAIN
    total = sizes.sum(axis=1) + np.where(moved, 3 * MARK, 0)
    start = np.concatenate([[0], np.cumsum(total)])
    pre, mid, suf = sizes.T
    first = start[:-1]
    places = np.zeros_like(sizes)
    marks = np.zeros_like(sizes)
    psm, spm = form == PSM, form == SPM
    places[:, 0] = first + np.where(psm, MARK, np.where(spm, 2 * MARK + suf, 0))
    places[:, 2] = first + np.where(psm, 2 * MARK + pre, np.where(spm, MARK, 0))
    places[:, 1] = first + np.where(moved, 3 * MARK + pre + suf, 0)
    # marks in the order prefix, suffix, middle
    marks[:, 0] = first + np.where(spm, MARK + suf, 0)
    marks[:, 1] = first + np.where(psm, MARK + pre, 0)
    marks[:, 2] = first + 2 * MARK + pre + suf
    # an empty piece of a plain text stands where the text ends
    plain = ~moved
    places[plain, 1] = places[plain, 2] = start[1:][plain]
    return places, marks, start


def rearranged(data: np.ndarray, at: np.ndarray, draw: np.ndarray, known: np.ndarray, rate: int, spm_rate: int):
    """All texts of a batch in their forms: output bytes, output borders, units, forms, prefix and middle characters."""
    texts = len(at) - 1
    lines = np.flatnonzero(data == 10)
    n_lines, before = counted(lines, at)
    filled = at[1:] > at[:-1]
    open_end = np.zeros(texts, bool)
    open_end[filled] = data[at[1:][filled] - 1] != 10
    n = n_lines + open_end
    held = np.zeros(texts, bool)
    for where in marks_in(data, at):
        held |= counted(where, at)[0] > 0
    plain = ~known | ~filled | held | (draw[:, 2] % 100 >= rate)
    form = np.where(plain, PLAIN, np.where(draw[:, 3] % 100 < spm_rate, SPM, PSM))
    cuts = np.sort(draw[:, :2] % (n[:, None] + 1), axis=1)
    one = np.where(plain, at[1:], unit_end(lines, before, n_lines, at, cuts[:, 0]))
    two = np.where(plain, at[1:], unit_end(lines, before, n_lines, at, cuts[:, 1]))
    begin = np.stack([at[:-1], one, two], axis=1)
    sizes = np.diff(np.concatenate([begin, at[1:, None]], axis=1), axis=1)
    places, marks, start = laid_out(sizes, form)
    out = np.zeros(int(start[-1]), np.uint8)
    displace(data, begin.ravel(), (places - begin).ravel(), out, gather=False)
    moved = form != PLAIN
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        for i, byte in enumerate(mark):
            out[marks[moved, k] + i] = byte
    chars = np.stack([letters(data, a, b) for a, b in ((at[:-1], one), (one, two))], axis=1)
    return out, start, n, form, chars


def letters(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between byte positions that do not overlap and follow one another."""
    total = np.zeros(len(first), np.int64)
    for lo in range(0, len(data), WINDOW):
        hi = min(len(data), lo + WINDOW)
        sums = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
        total += sums[np.clip(end, lo, hi) - lo] - sums[np.clip(first, lo, hi) - lo]
    return total


def restored(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs were made of, from outputs and forms alone: marks are searched, pieces gathered."""
    moved = form != PLAIN
    where = np.zeros((len(form), 3), np.int64)
    for k, found in enumerate(marks_in(data, at)):
        text = np.searchsorted(at, found, side="right") - 1
        found, text = found[moved[text]], text[moved[text]]
        # a text holds each mark once: that was the condition of being moved
        where[text, k] = found
    p, s, m = where.T
    end, psm = at[1:], form == PSM
    pieces = np.stack([
        np.where(moved, p + MARK, at[:-1]), np.where(moved, m + MARK, end), np.where(moved, s + MARK, end)], axis=1)
    ends = np.stack([
        np.where(moved, np.where(psm, s, m), end), end, np.where(moved, np.where(psm, m, p), end)], axis=1)
    sizes = ends - pieces
    begin = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.zeros(int(begin[-1]), np.uint8)
    displace(data, begin[:-1], pieces.ravel() - begin[:-1], out, gather=True)
    return out, begin[np.arange(len(form) + 1) * 3]


def as_strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def rearrange(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Texts with their middle moved to the end: id, `n` lines, `form`, `prefix_chars`, `middle_chars`, `output`.

    Cuts stand after whole lines and are drawn from the id, so the same row gives the same
    output wherever and however often it is run, repeated rows included. `rate` percent are
    moved, `spm_rate` percent of these with the suffix first. Plain, with null characters,
    are: an empty or null text, a text that holds a mark, a text whose id is null (there is
    nothing to draw from). An empty table gives an empty result; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            data, at = bytes_of(batch.column("text"))
            ids = batch.column("id")
            known = np.asarray(ids.is_valid())
            out, start, n, form, chars = rearranged(data, at, draws(ids.to_pylist(), seed), known, rate, spm_rate)
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form], pa.string()),
                pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1], pa.int64(), mask=plain),
                as_strings(out, start)], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = rows.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows of `rearrange` with `restored`, the exact text, rebuilt from output and form alone."""
    names = [c for c in made.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, output_col):
            data, at = bytes_of(batch.column(output_col))
            kinds = batch.column(form_col).to_numpy(zero_copy_only=False)
            form = np.select([kinds == FORMS[PSM], kinds == FORMS[SPM]], [PSM, SPM], PLAIN)
            out, start = restored(data, at, form)
            yield pa.RecordBatch.from_arrays([*batch.columns, as_strings(out, start)], [*names, "restored"])

    rows = made.select(*names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())]))


SQL = """WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS hex,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines FROM documents),
drawn AS (
  SELECT *, len(lines) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT doc_id, n, form, text, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid,
         array_to_string(lines[b + 1:n], '') AS suf FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM pieces"""
