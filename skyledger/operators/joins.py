"""Catalog joins: crosswalks, overrides, lookups and match combination.

Sides are never broadcast by hint here: Catalyst broadcasts a side whose size it
knows to be under the threshold, and AQE splits skewed keys otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import exprs as x
from skyledger.operators.dedup import keep_best, keep_first, keep_most_complete, keep_nearest


def attach_star_table(spectra: DataFrame, stars: DataFrame, key: str, columns: Sequence[str],
                      row_id: Sequence[str]) -> DataFrame:
    """Left join of a star table with repeated keys; never changes the row count.

    The most complete row per key survives, so at most one row matches.
    """
    wanted = stars.select(*dict.fromkeys([key, *columns, *row_id]))
    unique = keep_most_complete(wanted, [key], columns, row_id).select(key, *columns)
    return spectra.join(unique, key, "left")


def override_bands(df: DataFrame, aux: DataFrame, key: str, bands: Mapping[str, str],
                   row_id: Sequence[str], flag: str = "survey_ind") -> DataFrame:
    """Replace bands by auxiliary values where finite.

    ``flag`` is 1 only on rows where every overridden band came from ``aux``.
    """
    aux_cols = list(bands.values())
    unique = keep_first(aux.select(*dict.fromkeys([key, *aux_cols, *row_id])), [key], row_id)
    names = {c: f"__aux_{c}" for c in aux_cols}
    unique = unique.select(key, *[F.col(c).alias(names[c]) for c in aux_cols])
    joined = df.join(unique, key, "left")
    all_from_aux = reduce(lambda a, b: a & b, [x.is_finite(names[c]) for c in aux_cols])
    return joined.withColumns({
        **{band: F.coalesce(x.finite(names[c]), F.col(band)) for band, c in bands.items()},
        flag: F.when(all_from_aux, 1.0).otherwise(0.0)}).drop(*names.values())


def crosswalk(df: DataFrame, xref: DataFrame, left_id: str, xref_left: str, xref_right: str,
              new_col: str, row_id: Sequence[str]) -> DataFrame:
    """Attach an external id; zero ids do not count and ids stay integers."""
    usable = xref.filter(F.col(xref_right) != 0)
    first = keep_first(usable.select(*dict.fromkeys([xref_left, xref_right, *row_id])), [xref_left],
                       row_id)
    return df.join(first.select(F.col(xref_left).alias(left_id), F.col(xref_right).alias(new_col)),
                   left_id, "left")


def confirm_pairs(candidates: DataFrame, official: DataFrame, keys: Sequence[str],
                  one_per: str, distance: str) -> DataFrame:
    """Candidate pairs that an official table lists; the closest per left id."""
    both = candidates.select(*keys).distinct().join(official, list(keys))
    rest = [k for k in keys if k != one_per]
    return keep_nearest(both, [one_per], distance, rest).drop("n_in_radius")


def members_only(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key), key, "left_semi")


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def normalised_id(c: str | Column) -> Column:
    """Trimmed, upper case, without any '2M' (inner ones go too)."""
    return F.regexp_replace(F.upper(F.trim(x.col(c))), "2M", "")


def match_members(catalog: DataFrame, members: DataFrame, cat_id: str, mem_id: str, cluster: str,
                  row_id: str, normalise: bool = False) -> DataFrame:
    """Distinct (cluster, row id) of members found in the catalog.

    With repeated catalog ids the first row wins. Null ids never match.
    """
    key = normalised_id if normalise else (lambda c: F.trim(F.col(c).cast("string")))
    first = (catalog.select(key(cat_id).alias("__k"), row_id).filter(F.col("__k").isNotNull())
             .groupBy("__k").agg(F.min(row_id).alias(row_id)))
    wanted = members.select(cluster, key(mem_id).alias("__k"))
    return wanted.join(first, "__k").select(cluster, row_id).distinct()


def membership_probability(members: DataFrame, probs: DataFrame, cluster: str, gaia_id: str,
                           prob: str, prob_min: float) -> DataFrame:
    """Members with their probability in that cluster at or above the cut; of a repeated id the highest.

    A cluster without any catalogue loses all its members, which ``no_catalogue``
    would flag before the cut: see ``uncatalogued``.
    """
    one = probs.groupBy(cluster, gaia_id).agg(F.max(prob).alias("memberprob"))
    joined = members.join(one, [cluster, gaia_id], "left")
    return joined.filter(x.in_range("memberprob", lo=prob_min))


def uncatalogued(members: DataFrame, probs: DataFrame, cluster: str) -> DataFrame:
    """Clusters whose members are all dropped because no catalogue names them."""
    return (members.join(probs.select(cluster).distinct(), cluster, "left_anti")
            .groupBy(cluster).agg(F.count(F.lit(1)).alias("n_dropped"),
                                  F.lit(True).alias("no_catalogue")))


def combine_matches(targets: DataFrame, matches: Mapping[str, tuple[DataFrame, str]], key: str,
                    echoed: Sequence[str], row_id: Mapping[str, Sequence[str]],
                    require: str = "none") -> DataFrame:
    """Targets with several match tables side by side and ``in_<name>`` flags.

    ``matches`` maps a name to (table, separation column). Unmatched rows of a
    table are dropped, the nearest per id is kept, echoed coordinates go and
    colliding columns get the name as suffix.
    """
    if require not in ("none", "any", "both"):
        raise ValueError("require must be none, any or both")
    out = targets
    for name, (table, sep) in matches.items():
        found = table.filter(x.in_range(sep))
        near = keep_best(found, [key], [F.col(sep), *[F.col(c) for c in row_id[name]]])
        near = near.drop(*[c for c in echoed if c != key])
        taken = set(out.columns)
        near = near.select(*[F.col(c) if c == key or c not in taken else F.col(c).alias(f"{c}_{name}")
                             for c in near.columns], F.lit(True).alias(f"in_{name}"))
        out = out.join(near, key, "left").withColumn(f"in_{name}", x.holds(F.col(f"in_{name}")))
    flags = [F.col(f"in_{name}") for name in matches]
    if require == "any":
        out = out.filter(reduce(lambda a, b: a | b, flags))
    elif require == "both":
        out = out.filter(reduce(lambda a, b: a & b, flags))
    return out


def match_overlap(combined: DataFrame, a: str, b: str) -> DataFrame:
    """One row: counts and shares of each match, both and either."""
    fa, fb = F.col(f"in_{a}"), F.col(f"in_{b}")
    n = F.count(F.lit(1))
    counts = {f"n_{a}": fa, f"n_{b}": fb, "n_both": fa & fb, "n_either": fa | fb}
    return combined.agg(n.alias("n"), *[F.count_if(p).alias(k) for k, p in counts.items()],
                        *[(100.0 * F.count_if(p) / n).alias(k.replace("n_", "pct_"))
                          for k, p in counts.items()])


def label_lookup(df: DataFrame, key: str, label: str, first: DataFrame, second: DataFrame,
                 row_id: Sequence[str]) -> DataFrame:
    """Label from the first table if it has the column, else from the second."""
    source = first if label in first.columns else second
    unique = keep_first(source.select(*dict.fromkeys([key, label, *row_id])), [key], row_id)
    return df.join(unique.select(key, label), key, "left")


def reuse_results(meta: DataFrame, results: DataFrame, key: str,
                  columns: Sequence[str] = ("plx_sp", "err_sp")) -> DataFrame:
    """Earlier predictions on the metadata rows; null where never scored."""
    return meta.join(results.select(key, *columns), key, "left")


def attach_column(df: DataFrame, master: DataFrame, key: str, column: str,
                  row_id: Sequence[str]) -> DataFrame:
    """One column of a master table, rows with a missing value left out of the map."""
    known = master.filter(F.col(column).isNotNull())
    unique = keep_first(known.select(*dict.fromkeys([key, column, *row_id])), [key], row_id)
    return df.join(unique.select(key, column), key, "left")


def common_ids(groups: DataFrame, group: str, key: str, catalog: DataFrame, cat_key: str) -> DataFrame:
    """Per group: how many of its distinct ids the catalog has."""
    have = catalog.select(F.col(cat_key).alias(key)).distinct()
    found = groups.select(group, key).distinct().join(
        have.withColumn("__hit", F.lit(1)), key, "left")
    return found.groupBy(group).agg(F.count("__hit").alias("n_matched"),
                                    F.count(F.lit(1)).alias("n_ids"))
