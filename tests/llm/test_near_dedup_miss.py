"""How often near_dedup's signatures can miss a link."""

from math import comb

from framelore.llm import near_dedup


def test_a_borderline_pair_is_missed_below_one_in_a_million():
    n, p = near_dedup.COORDINATES, near_dedup.NUMERATOR / near_dedup.DENOMINATOR
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(near_dedup.MATCHES)) < 1e-6
