"""Removal of alternative alleles from VCF records, with all values that are given by allele or by genotype.

A record is its array of fields. Which alleles stay is an array of flags, the reference's first. Genotypes of ploidy p are
listed so that those of the first alleles come first; so the flags of ploidy p are those of p - 1, cut for each last allele.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial, prod

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of a record's fields, from 0.
ALT, INFO, FORMAT, SAMPLES = 4, 7, 8, 9


def _texts(of: Column) -> Column:
    return F.when((of == ".") | (of == ""), F.array().cast("array<string>")).otherwise(F.split(of, ","))


def flags(alt: Column, drop: Column) -> Column:
    """Whether each allele stays. drop: array of allele numbers; 0, null and numbers that don't exist drop nothing."""
    return F.concat(F.array(F.lit(True)), F.transform(_texts(alt), lambda _, k: ~F.array_contains(F.coalesce(drop, F.array().cast("array<int>")), (k + 1).cast("int"))))


def unused(alt: Column, genotypes: Column) -> Column:
    """Numbers of the alternatives that no genotype of the array holds; none where there is no genotype at all."""
    held = F.flatten(F.transform(F.filter(genotypes, lambda g: g.isNotNull()), lambda g: F.split(g, "[/|]")))
    all_ = F.transform(_texts(alt), lambda _, k: (k + 1).cast("int"))
    return F.when(F.size(held) == 0, F.array().cast("array<int>")).otherwise(F.filter(all_, lambda a: ~F.array_contains(held, a.cast("string"))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as the variable of a function over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _genotypes(n: Column, p: int) -> Column:
    """How many genotypes of ploidy p there are over n alleles."""
    return F.floor(prod([n + k for k in range(1, p)], start=n) / factorial(p)).cast("int")


def genotype_flags(keep: Column, ploidy: int) -> Column:
    """Whether each genotype of a ploidy holds kept alleles only, in the order of genotypes."""

    def longer(p: int) -> Callable[[Column], Column]:
        return lambda shorter: F.flatten(F.transform(keep, lambda ok, a: F.transform(F.slice(shorter, F.lit(1), _genotypes(a + 1, p - 1)), lambda g: g & ok)))

    out = keep
    for p in range(2, ploidy + 1):
        out = let(out, longer(p))
    return out


def _picked(text: Column, key: Column, keep: Column, numbers: dict[str, str], most: int) -> Column:
    """The values that stay. Values whose count fits no allele or genotype list, as a missing one, stay as they are. A list of flags is made only for the count that it fits."""
    by = {n: [k for k, v in numbers.items() if v == n] for n in "ARG"}
    n = F.size(keep)

    def fit(count: Column) -> Column:
        out = F.lit(None).cast("array<boolean>")
        if by["G"]:
            own = F.lit(None).cast("array<boolean>")
            for p in range(most, 0, -1):  # of ploidies with as many genotypes the least
                own = F.when(count == _genotypes(n, p), genotype_flags(keep, p)).otherwise(own)
            out = F.when(key.isin(by["G"]), own).otherwise(out)
        if by["R"]:
            out = F.when(key.isin(by["R"]), F.when(count == n, keep)).otherwise(out)
        if by["A"]:
            out = F.when(key.isin(by["A"]), F.when(count == n - 1, F.slice(keep, F.lit(2), n))).otherwise(out)
        return out

    def cut(v: Column) -> Column:
        return let(let(F.size(v), fit), lambda f: F.when(f.isNotNull(), F.array_join(F.filter(v, lambda _, k: F.get(f, k)), ",")))

    if not numbers:
        return text
    return let(F.when(key.isin(list(numbers)) & (text != "."), let(F.split(text, ","), cut)), lambda left: F.when(left.isNull(), text).when(left == "", ".").otherwise(left))


def renumbered(gt: Column, keep: Column) -> Column:
    """A genotype in the new numbers with its signs of phase; a dropped or unknown allele is missing."""

    def one(t: Column) -> Column:
        sign = F.regexp_extract(t, "^[/|]", 0)
        a = F.regexp_extract(t, "[0-9]+", 0).try_cast("int")
        new = (F.size(F.filter(F.slice(keep, F.lit(1), a + 1), lambda k: k)) - 1).cast("string")
        return F.concat(sign, F.when(F.coalesce(F.get(keep, a), F.lit(False)), new).otherwise("."))

    return F.array_join(F.transform(F.regexp_extract_all(gt, F.lit("([/|]?[^/|]+)")), one), "")


def without_alleles(fields: Column, drop: Column, info: dict[str, str], formats: dict[str, str], most: int = 4) -> Column:
    """The fields without the alternatives ``drop``. info, formats: A, R or G (by alternative, allele, genotype) by key; other keys
    stay. INFO has genotypes of two alleles, samples have up to ``most``. A record that loses nothing stays as it is."""
    at = lambda k: F.get(fields, F.lit(k))

    def one_info(e: Column, keep: Column) -> Column:
        own = lambda key: F.when(key.isin(list(info)) & (key != e), F.concat(key, F.lit("="), _picked(F.substring(e, F.length(key) + 2, F.length(e)), key, keep, info, 2))).otherwise(e)
        return let(F.substring_index(e, "=", 1), own)

    def one_value(v: Column, key: Column, keep: Column) -> Column:
        return F.when(key == "GT", renumbered(v, keep)).otherwise(_picked(v, key, keep, formats, most))

    def new(keep: Column) -> Column:
        left = F.array_join(F.filter(_texts(at(ALT)), lambda _, k: F.get(keep, k + 1)), ",")
        sample = lambda s, keys: F.array_join(F.transform(F.split(s, ":"), lambda v, k: let(F.get(keys, k), lambda key: one_value(v, key, keep))), ":")
        head = F.transform(F.slice(fields, 1, SAMPLES), lambda f, k: F.when(k == ALT, F.when(left == "", ".").otherwise(left)).when(k == INFO, F.array_join(F.transform(F.split(f, ";"), lambda e: one_info(e, keep)), ";")).otherwise(f))
        samples = F.slice(fields, F.lit(SAMPLES + 1), F.greatest(F.size(fields) - SAMPLES, F.lit(0)))
        return F.concat(head, let(F.split(at(FORMAT), ":"), lambda keys: F.transform(samples, lambda s: sample(s, keys))))

    def record(keep: Column) -> Column:
        return F.when(F.exists(keep, lambda k: ~k), new(keep)).otherwise(fields)

    return let(flags(at(ALT), drop), record)


def trimmed(fields: Column, info: dict[str, str], formats: dict[str, str], most: int = 4) -> Column:
    """The fields without the alternatives that no sample holds. Without GT nothing goes."""
    place = F.array_position(F.split(F.get(fields, F.lit(FORMAT)), ":"), "GT").cast("int")
    gts = F.transform(F.slice(fields, F.lit(SAMPLES + 1), F.greatest(F.size(fields) - SAMPLES, F.lit(0))), lambda s: F.when(place > 0, F.get(F.split(s, ":"), place - 1)))
    return without_alleles(fields, unused(F.get(fields, F.lit(ALT)), F.when(place > 0, gts).otherwise(F.array().cast("array<string>"))), info, formats, most)
