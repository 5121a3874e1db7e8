"""Codecs between tokens, bits, Gray code, error-corrected words and code sequences, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_gray(n: Column) -> Column:
    return n.bitwiseXOR(F.shiftright(n, 1))


def from_gray(g: Column, width: int = 32) -> Column:
    """Inverse for up to ``width`` bits, by doubling shifts."""
    for k in (1, 2, 4, 8, 16):
        if k < width:
            g = g.bitwiseXOR(F.shiftright(g, k))
    return g


def bits_for(vocabulary: Column) -> Column:
    """Least number of bits for ids below ``vocabulary`` (at least 2 ids)."""
    return F.length(F.bin(F.greatest(vocabulary, F.lit(2)).cast("long") - 1))


def token_bits(token: Column, width: int) -> Column:
    """Bits of a token, most significant first."""
    return F.array(*[F.shiftright(token, k).bitwiseAND(1).cast("tinyint") for k in range(width - 1, -1, -1)])


def bits_value(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b)


def sequence_bits(ids: Column, width: int) -> Column:
    return F.flatten(F.transform(ids, lambda t: token_bits(t, width)))


def bits_tokens(bits: Column, width: int, vocabulary: int | None = None) -> Column:
    """Tokens of whole groups of ``width`` bits, an incomplete tail left out; ids modulo ``vocabulary`` if given."""
    n = F.floor(F.size(bits) / width).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: bits_value(F.slice(bits, k * width + 1, F.lit(width))))).otherwise(F.array().cast("array<long>"))
    return F.transform(ids, lambda t: t % vocabulary) if vocabulary else ids


# Single-error-correcting, double-error-detecting words. A word is an integer whose bits are, most significant
# first, the m data bits, the r parity bits and the overall parity.


def parity_size(m: int) -> int:
    """Least r with 2 ** r >= m + r + 1."""
    r = 0
    while 1 << r < m + r + 1:
        r += 1
    return r


def _positions(m: int) -> list[int]:
    """Code positions of the data bits: those that are no powers of two, in order."""
    return [p for p in range(1, m + parity_size(m) + 1) if p & (p - 1)]


def _parity_mask(m: int, k: int) -> int:
    """The data bits, as a mask on the token, whose positions have bit ``k``."""
    return sum(1 << (m - 1 - i) for i, p in enumerate(_positions(m)) if p >> k & 1)


def _odd(x: Column) -> Column:
    return F.bit_count(x).bitwiseAND(1)


def _with_parities(token: Column, m: int) -> Column:
    token = token.cast("long")
    parities = [_odd(token.bitwiseAND(_parity_mask(m, k))) for k in range(parity_size(m))]
    return reduce(lambda word, p: F.shiftleft(word, 1).bitwiseOR(p.cast("long")), parities, token)


def _closed(body: Column) -> Column:
    return F.shiftleft(body, 1).bitwiseOR(_odd(body).cast("long"))


def secded_encode(token: Column, m: int) -> Column:
    return _closed(_with_parities(token, m))


def secded_words(ids: Column, m: int) -> Column:
    """Words of an array of tokens. Parities are put on first, so that each is made once."""
    return F.transform(F.transform(ids, lambda t: _with_parities(t, m)), _closed)


def secded_decode(word: Column, m: int) -> Column:
    """``struct<data, corrected, uncorrectable>``.

    One flipped bit is put right (a flip of the overall parity alone counts as one correction). An even number of
    flips that shows is uncorrectable, and so is a syndrome that names no position, which three flips can make.
    """
    data, syndrome, odd = secded_parts(word, m)
    fixed, single, uncorrectable = secded_choice(data, syndrome, odd, m)
    return F.struct(fixed.alias("data"), (single | (odd & (syndrome == 0))).cast("int").alias("corrected"), uncorrectable.alias("uncorrectable"))


def secded_parts(word: Column, m: int) -> tuple[Column, Column, Column]:
    """Data bits of a word, its syndrome, and whether its overall parity is broken."""
    r = parity_size(m)
    word = word.cast("long")
    data = F.shiftright(word, r + 1)
    checks = [(_odd(data.bitwiseAND(_parity_mask(m, k))) + F.getbit(word, F.lit(r - k)).cast("int")).bitwiseAND(1) for k in range(r)]
    return data, reduce(lambda a, b: a + b, [c * (1 << k) for k, c in enumerate(checks)]), _odd(word) == 1


def secded_choice(data: Column, syndrome: Column, odd: Column, m: int) -> tuple[Column, Column, Column]:
    """Data bits after repair, whether one of them or of the parities was flipped, and whether a word is uncorrectable."""
    flips = [0] * (m + parity_size(m) + 1)
    for i, p in enumerate(_positions(m)):
        flips[p] = 1 << (m - 1 - i)
    named = syndrome <= m + parity_size(m)
    flip = F.element_at(F.array(*[F.lit(f).cast("long") for f in flips]), F.when(named, syndrome).otherwise(F.lit(0)) + 1)
    single = odd & named & (syndrome > 0)
    return F.when(single, data.bitwiseXOR(flip)).otherwise(data), single, (~odd & (syndrome > 0)) | (odd & ~named)


def secded_ids(words: Column, m: int, unknown: int, vocabulary: int) -> Column:
    """Ids of an array of words, ``unknown`` for an uncorrectable one. Syndromes are made first, so that each is made once."""

    def parts(word: Column) -> Column:
        data, syndrome, odd = secded_parts(word, m)
        return F.struct(data.alias("data"), syndrome.alias("syndrome"), odd.alias("odd"))

    def ids(p: Column) -> Column:
        data, _, uncorrectable = secded_choice(p["data"], p["syndrome"], p["odd"], m)
        return F.when(uncorrectable, F.lit(unknown).cast("long")).otherwise(data % vocabulary)

    return F.transform(F.transform(words, parts), ids)


def stop_codes(ids: Column, pad: int, end: int, vocabulary: int, unknown: int | None = None) -> Column:
    """Cut a code sequence at its first pad or end mark and drop ids out of range; the unknown id is kept.

    Returns ``struct<kept, n_input, n_kept, n_invalid, n_unknown, hit_pad, hit_end, stop>``; ``stop`` is -1 where
    nothing stops it.
    """
    at = lambda x: F.when(F.array_position(ids, x) > 0, F.array_position(ids, x) - 1)
    p, e = at(F.lit(pad)), at(F.lit(end))
    stop = F.least(p, e)
    head = F.slice(ids, 1, F.coalesce(stop, F.size(ids)).cast("int"))
    in_range = lambda t: (t >= 0) & (t < vocabulary)
    is_unknown = (lambda t: ~in_range(t) & (t == unknown)) if unknown is not None else (lambda t: F.lit(False))
    kept = F.filter(head, lambda t: in_range(t) | is_unknown(t))
    return F.struct(
        kept.alias("kept"), F.size(ids).alias("n_input"), F.size(kept).alias("n_kept"), (F.size(head) - F.size(kept)).alias("n_invalid"),
        F.size(F.filter(head, is_unknown)).alias("n_unknown"), F.coalesce((p == stop).cast("int"), F.lit(0)).alias("hit_pad"),
        F.coalesce((e == stop).cast("int"), F.lit(0)).alias("hit_end"), F.coalesce(stop, F.lit(-1)).cast("int").alias("stop"),
    )


def strip_edges(ids: Column, mark: int) -> Column:
    """Without one leading and one trailing mark; inner ones stay."""
    head = F.when(F.try_element_at(ids, F.lit(1)) == mark, F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    return F.transform(F.array(head), lambda x: F.when(F.try_element_at(x, F.lit(-1)) == mark, F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x))[0]


def finish_codes(ids: Column, end: int, pad: int, length: int) -> Column:
    """Append the end mark, cut to ``length`` with the end mark last, fill up with pads."""
    closed = F.when(F.size(ids) + 1 > length, F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(end)))).otherwise(F.concat(ids, F.array(F.lit(end))))
    return F.slice(F.concat(closed, F.array_repeat(F.lit(pad), length)), 1, length)


def fit(ids: Column, length: int, pad: int) -> Column:
    """Cut or fill up on the right to ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def best_index(scores: Column) -> Column:
    """Index of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def reorder(values: Column, order: Column) -> Column:
    """Values in the order of zero-based indices."""
    return F.transform(order, lambda i: F.element_at(values, i.cast("int") + 1))


def invert_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def private_text(ids: Column, offset: int) -> Column:
    """Ids as characters from ``offset`` on, one each: a text that tokenizers can be trained on."""
    codes = F.array_join(F.transform(ids, lambda t: F.lpad(F.hex(t.cast("long") + offset), 8, "0")), "")
    # The decoder takes one U+FEFF off the start as a byte order mark; it gets one of its own, so that an id's stays.
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), codes)), "UTF-32")


def private_ids(text: Column, offset: int, vocabulary: int, invalid: str = "raise", end: int | None = None) -> Column:
    """Ids of such a text. A character outside the vocabulary is an error, is skipped, or becomes the ``end`` mark, as
    ``invalid`` says (``raise``, ``skip``, ``eos``)."""
    if invalid not in ("raise", "skip", "eos") or (invalid == "eos" and end is None):
        raise ValueError(f"characters outside the vocabulary: {invalid!r}, end mark {end}")
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long") - offset
    ids = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code)
    valid = lambda t: (t >= 0) & (t < vocabulary)
    if invalid == "skip":
        return F.filter(ids, valid)
    other = F.lit(end).cast("long") if invalid == "eos" else F.raise_error(F.lit("a character is outside the vocabulary")).cast("long")
    return F.transform(ids, lambda t: F.when(valid(t), t).otherwise(other))


def start_positions(n: Column, k: int, first: int = 0, strategy: str = "even", seed: int = 0) -> Column:
    """``k`` distinct places below ``n`` (all where there are fewer), ``first`` among them: spread evenly with halves
    rounded to even, or drawn by hashes of the seed. Repeats give way to the lowest places that are free."""
    n = n.cast("long")
    begin = F.pmod(F.lit(first).cast("long"), n)
    if strategy == "even":
        drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.bround(begin + i * (n / F.least(F.lit(k), n)), 0).cast("long"), n))
    elif strategy == "random":
        drawn = F.concat(F.array(begin), F.transform(F.sequence(F.lit(1), F.lit(4 * k)), lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), n)))
    else:
        raise ValueError(f"starts are even or random, not {strategy!r}")
    taken = F.slice(F.array_distinct(drawn), 1, k)
    free = F.array_except(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(2 * k)) - 1), taken)
    return F.slice(F.concat(taken, free), F.lit(1), F.least(F.lit(k), n).cast("int"))


def safe_decode(data: Column, unknown: str = "<unk>") -> Column:
    """Bytes as UTF-8, where what is malformed becomes the replacement character; nothing at all is ``unknown``."""
    return F.when(data.isNull(), F.lit(unknown)).otherwise(F.decode(data, "UTF-8"))
