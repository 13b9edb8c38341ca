"""64-bit SimHash pieces as Catalyst expressions.

Fingerprint rule (our own, documented in FIXTURES.md B4): tokens are the
maximal runs of letters/digits of the lower-cased text; a token's hash is the
first 16 hex digits of its MD5 read as a 64-bit integer; bit ``i`` of the
fingerprint is set when more tokens have that bit set than not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import let

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
BITS = 64
TWO_64 = 18446744073709551616


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_hash(token: Column) -> Column:
    """Signed 64-bit value of the first 16 hex digits of md5(token)."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")


# Two 32-bit counters share one 64-bit sum: bit i counts in the low half,
# bit i+32 in the high half.  Exact while a document has < 2**31 tokens.
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def bit_count_aggs(h: Column) -> list[Column]:
    """32 partial-aggregatable sums holding, per document, how many token
    hashes have each of the 64 bits set."""
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"_b{i}") for i in range(BITS // 2)]


def _majority(sums: Column, n: Column) -> Column:
    """OR of the bits whose set-count is a strict majority of ``n`` tokens, from
    an array of the packed sums."""
    zero = F.lit(0).cast("bigint")

    def bit(acc: Column, i: Column) -> Column:
        packed = F.get(sums, F.pmod(i, F.lit(BITS // 2)))
        count = F.when(i < BITS // 2, packed.bitwiseAND(F.lit(_LOW))).otherwise(F.shiftrightunsigned(packed, 32))
        return acc.bitwiseOR(F.when(F.lit(2) * count > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(zero))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), zero, bit)


def fingerprint_from_counts(n: Column) -> Column:
    """The fingerprint of a document with ``n`` tokens and the sums of
    ``bit_count_aggs``."""
    return let(F.array(*[F.coalesce(F.col(f"_b{i}"), F.lit(0).cast("bigint")) for i in range(BITS // 2)]), lambda sums: _majority(sums, n))


def fingerprint(toks: Column) -> Column:
    """The fingerprint of a row's own token array, without a shuffle: the same
    sums as ``bit_count_aggs``, folded over the array."""
    mask = F.lit(_LANES)

    def fold(hashes: Column) -> Column:
        def lane(i: Column) -> Column:
            return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(mask))
        return let(F.transform(F.sequence(F.lit(0), F.lit(BITS // 2 - 1)), lane), lambda sums: _majority(sums, F.size(hashes)))

    return let(F.transform(toks, token_hash), fold)


def band(h: Column, k: int) -> Column:
    """B2: 16-bit band ``k`` (0 = lowest bits), via an unsigned shift."""
    return F.shiftrightunsigned(h, K.SIMHASH_BAND_BITS * k).bitwiseAND(F.lit(0xFFFF)).cast("int")


def bands(h: Column) -> Column:
    return F.array(*[band(h, k) for k in range(K.SIMHASH_BANDS)])


def similarity(a: Column, b: Column) -> Column:
    """``1 - hamming(a, b) / 64``."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)).cast("double") / F.lit(float(BITS))


def unsigned_text(h: Column) -> Column:
    """B4 edge form: the unsigned decimal text the reference stores."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(wide).cast("string")


def from_text(s: Column) -> Column:
    """Decimal text (unsigned or signed) -> signed 64-bit value; NULL if
    the text is not all digits."""
    digits = F.regexp_extract(s, r"^-?[0-9]+$", 0)
    wide = F.when(digits != "", digits).try_cast("decimal(20,0)")
    return F.when(wide >= F.lit(str(2 ** 63)).cast("decimal(20,0)"),
                  (wide - F.lit(str(TWO_64)).cast("decimal(20,0)"))).otherwise(wide).try_cast("bigint")
