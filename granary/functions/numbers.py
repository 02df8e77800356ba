"""Rounding and number text, written so that other engines give the same digits."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """floor(x * 10**n + 0.5) / 10**n: halves go up, also below zero; null stays null."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def percent_change(old: Column, new: Column, digits: int = 1) -> Column:
    """In percent of the old value's size; null if that is null or zero."""
    return F.when(old != 0, rounded((new - old) / F.abs(old) * 100.0, digits))


def mean_of_hundredths(x: Column) -> Column:
    """The mean of values with two digits, itself with two; summed as whole numbers, so in any order the same."""
    cents = F.sum(F.floor(x * 100.0 + 0.5))
    return F.floor(cents / F.count(x) + 0.5) / 100.0
