"""Record linkage: blocking, match scores, bridges and clusters that hold one surname."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.udfs import jaro_winkler
from tessella.session import ship

# Probabilities from which pairs are merged, or kept as a middle band.
MERGE, MIDDLE = 0.92, 0.55
# Fixed value: the share of matching pairs that have one name or one address.
RULE_RECALL = 0.8
#: Names whose pairs show how alike unequal names are by chance: 101,025 pairs.
SAMPLED = 450
#: Levels of name similarity after equality.
NAME_LEVELS = (0.92, 0.88, 0.70)


def person_frame(mentions: DataFrame, key: str, surface: str) -> DataFrame:
    """id, name_norm, surname, email_local, handle_stem; what is blank is null."""
    form = F.col(surface)
    mail = T.email_local(form)
    name = F.nullif(T.normalize_name(form), F.lit(""))
    return mentions.select(F.col(key).alias("id"), name.alias("name_norm"), F.when(mail.isNull(), T.surname(name)).alias("surname"), mail.alias("email_local"), T.handle_stem(form).alias("handle_stem"))


def blocked_pairs(people: DataFrame, keys: list[str]) -> DataFrame:
    """id_l < id_r, rule: pairs that share a key, each under the first key it shares."""
    a, b = people.alias("a"), people.alias("b")
    out = None
    for i, key in enumerate(keys):
        same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.id") < F.col("b.id"))
        for before in keys[:i]:
            same = same & ~F.coalesce(F.col(f"a.{before}") == F.col(f"b.{before}"), F.lit(False))
        pairs = a.join(b, same).select(F.col("a.id").alias("id_l"), F.col("b.id").alias("id_r"), F.lit(key).alias("rule"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def deterministic_pairs(people: DataFrame) -> DataFrame:
    """Pairs by equal keys alone, with a fixed probability each: the best rule counts."""
    # The probability that each rule stands for.
    rules = {"email_local": 1.0, "handle_stem": 0.97, "name_norm": 0.95}
    pairs = None
    for key, p in rules.items():
        same = people.alias("a").join(people.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.id") < F.col("b.id")))
        one = same.select(F.col("a.id").alias("id_l"), F.col("b.id").alias("id_r"), F.lit(p).alias("probability"))
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs.groupBy("id_l", "id_r").agg(F.max("probability").alias("probability"))


def name_level(a: Column, b: Column, similarity: Column) -> Column:
    """4 for equal names, 3, 2 and 1 for the levels below, 0 else; -1 if one is null."""
    level = F.when(a.isNull() | b.isNull(), -1).when(a == b, 4)
    for k, at in zip((3, 2, 1), NAME_LEVELS):
        level = level.when(similarity >= at, k)
    return level.otherwise(0)


def equal_level(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), -1).when(a == b, 1).otherwise(0)


def compared(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """pairs with gamma_name, gamma_email and gamma_handle."""
    ship(people.sparkSession)
    side = lambda s: people.select(*(F.col(c).alias(f"{c}_{s}") for c in people.columns))
    both = pairs.join(side("l"), "id_l").join(side("r"), "id_r")
    distinct = both.select("name_norm_l", "name_norm_r").where("name_norm_l IS NOT NULL AND name_norm_r IS NOT NULL").distinct()
    alike = distinct.withColumn("similarity", jaro_winkler("name_norm_l", "name_norm_r"))
    both = both.join(alike, ["name_norm_l", "name_norm_r"], "left")
    col = F.col
    return both.withColumn("gamma_name", name_level(col("name_norm_l"), col("name_norm_r"), col("similarity"))).withColumn("gamma_email", equal_level(col("email_local_l"), col("email_local_r"))).withColumn("gamma_handle", equal_level(col("handle_stem_l"), col("handle_stem_r")))


def agreement_patterns(gammas: DataFrame) -> DataFrame:
    """How many pairs have each pattern of agreement; at most 6 * 3 * 3 rows, whatever the input."""
    return gammas.groupBy("gamma_name", "gamma_email", "gamma_handle").agg(F.count("*").alias("pairs"))


def coincidence(people: DataFrame, *keys: str) -> tuple[float, float]:
    """How many pairs of people have all keys, and how many of them agree in all: from counts, without making a pair."""
    known = people.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    each = known.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    row = each.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same")).first()
    n = row["n"] or 0.0
    return n * (n - 1) / 2, row["same"] or 0.0


def expected_matches(people: DataFrame, recall: float = RULE_RECALL) -> tuple[float, float]:
    """All pairs of people, and how many of them should match: those with one name or one address, by the share that these rules find."""
    n = people.count()
    same = coincidence(people, "name_norm")[1] + coincidence(people, "email_local")[1] - coincidence(people, "name_norm", "email_local")[1]
    return n * (n - 1) / 2, same / recall


def chance(people: DataFrame, sampled: int = SAMPLED) -> list[np.ndarray]:
    """How often pairs agree by chance, for each level of name, address and handle.

    Equality is counted over all people; the levels of unequal names are those of the pairs among `sampled` names, the
    first by their hash.
    """
    ship(people.sparkSession)
    names = people.where("name_norm IS NOT NULL").groupBy("name_norm").agg(F.count("*").alias("n")).orderBy(F.xxhash64("name_norm"), "name_norm").limit(sampled)
    a, b = (names.select(F.col("name_norm").alias(f"name_{s}"), F.col("n").alias(f"n_{s}")) for s in "lr")
    met = a.join(F.broadcast(b), F.col("name_l") < F.col("name_r")).withColumn("similarity", jaro_winkler("name_l", "name_r"))
    low = np.full(4, 0.5)
    for row in met.groupBy(name_level(F.col("name_l"), F.col("name_r"), F.col("similarity")).alias("level")).agg(F.sum(F.col("n_l") * F.col("n_r")).alias("n")).collect():
        low[row["level"]] += row["n"]
    name, mail, handle = ((same + 0.5) / (every + 1) for every, same in (coincidence(people, k) for k in ("name_norm", "email_local", "handle_stem")))
    return [np.append(low / low.sum() * (1 - name), name), np.array([1 - mail, mail]), np.array([1 - handle, handle])]


def learned(gammas: np.ndarray, n: np.ndarray, u: list[np.ndarray], share: float, left_out: int | None = None, rounds: int = 30) -> list[np.ndarray | None]:
    """How often matching pairs have each level, by expectation maximisation over a histogram of patterns; None for the comparison left out."""
    m = [np.linspace(1, 4 * len(x), len(x)) / np.linspace(1, 4 * len(x), len(x)).sum() for x in u]
    for _ in range(rounds):
        odds = np.full(len(n), share / (1 - share))
        for j in range(3):
            known = gammas[:, j] >= 0
            if j != left_out:
                odds[known] *= (m[j] / u[j])[gammas[known, j]]
        match = odds / (1 + odds)
        share = float(np.clip((match * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for j in range(3):
            w = np.array([(match * n)[gammas[:, j] == k].sum() + 1e-3 for k in range(len(u[j]))])
            m[j] = w / w.sum()
    return [None if j == left_out else m[j] for j in range(3)]


def predicted_pairs(people: DataFrame, least: float = MIDDLE) -> DataFrame:
    """id_l, id_r, probability of the pairs that share a surname, an address or a handle, from `least` on.

    The prior is that of expected_matches, agreement by chance that of chance; agreement of matches is learned twice,
    from pairs of one surname and from pairs of one handle (without the handle), and the mean taken. An address counts
    by how rare it is. What reaches the driver are histograms of 54 patterns. Where nothing can be learned or no pair is
    likely, the pairs are those of deterministic_pairs.
    """
    every, expected = expected_matches(people)
    u, found = chance(people), []
    for key, left_out in (("surname", None), ("handle_stem", 2)):
        p = agreement_patterns(compared(blocked_pairs(people, [key]), people)).toPandas()
        if not p.empty:
            n = p["pairs"].to_numpy(float)
            found.append(learned(p[["gamma_name", "gamma_email", "gamma_handle"]].to_numpy(), n, u, float(np.clip(expected / n.sum(), 0.01, 0.99)), left_out))
    m = [[e[j] for e in found if e[j] is not None] for j in range(3)]
    if not all(m):
        return deterministic_pairs(people)
    prior = float(np.clip(expected / every, 1e-9, 0.5))
    weight = [np.append(np.mean(x, axis=0) / y, 1.0) for x, y in zip(m, u)]  # the last is that of an unknown, level -1
    rows = [(a, b, c, float(prior / (1 - prior) * weight[0][a] * weight[1][b] * weight[2][c])) for a in range(-1, 5) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    odds = people.sparkSession.createDataFrame(rows, "gamma_name int, gamma_email int, gamma_handle int, odds double")
    known = people.where("email_local IS NOT NULL").agg(F.count("*").alias("known"))
    rare = people.where("email_local IS NOT NULL").groupBy("email_local").agg(F.count("*").alias("n")).crossJoin(F.broadcast(known)).select(F.col("email_local").alias("email_local_l"), (F.lit(float(u[1][1])) * F.col("known") / F.col("n")).alias("rare"))
    pairs = compared(blocked_pairs(people, ["surname", "email_local", "handle_stem"]), people).join(F.broadcast(odds), ["gamma_name", "gamma_email", "gamma_handle"]).join(rare, "email_local_l", "left")
    scored = pairs.withColumn("odds", F.col("odds") * F.when(F.col("gamma_email") == 1, F.col("rare")).otherwise(1.0))
    likely = kept(scored.select("id_l", "id_r", (F.col("odds") / (1 + F.col("odds"))).alias("probability")).where(F.col("probability") >= least))
    return deterministic_pairs(people) if likely.isEmpty() else likely


def band(probability: Column) -> Column:
    return F.when(probability >= MERGE, "merge").when(probability >= MIDDLE, "middle").otherwise("drop")


def bridges(people: DataFrame) -> DataFrame:
    """id_l, id_r of a name of several words and the addresses and handles that it suggests."""
    target = people.where("email_local IS NULL AND name_norm LIKE '% %'").select(F.col("id").alias("name_id"), F.explode(T.name_locals(F.col("name_norm"))).alias("local")).distinct()
    probe = people.select(F.col("id").alias("probe_id"), F.coalesce("email_local", F.when(~F.coalesce(F.col("name_norm").contains(" "), F.lit(False)), F.col("handle_stem"))).alias("local")).where("local IS NOT NULL")
    met = probe.join(target, "local").where("name_id <> probe_id")
    return met.select(F.least("name_id", "probe_id").alias("id_l"), F.greatest("name_id", "probe_id").alias("id_r")).distinct()


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir; without one (a single machine), persisted."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def components(pairs: DataFrame, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """id, component (the smallest id reachable): labels fall to the smallest neighbour's and then jump to their label's.

    Each round is kept. Raises if labels still change after so many rounds.
    """
    both = kept(pairs.select(F.col("id_l").alias("id"), F.col("id_r").alias("other")).unionByName(pairs.select(F.col("id_r").alias("id"), F.col("id_l").alias("other"))).distinct())
    label = kept(nodes.select("id").distinct().withColumn("component", F.col("id")))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("least"))
        low = label.join(near, "id", "left").select("id", F.col("component").alias("before"), F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = kept(low.join(jump, "component", "left").select("id", "before", F.coalesce("further", "component").alias("component")))
        changed = new.where("component <> before").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
    raise ValueError(f"labels still change after {rounds} rounds")


def guard(people: DataFrame) -> DataFrame:
    """id, surname for the guard: names of one word and addresses have none."""
    return people.select("id", F.when(F.col("name_norm").contains(" "), F.col("surname")).alias("surname"))


def guarded_clusters(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """id, cluster: unions from the strongest pair down, refused where two surnames would meet.

    Unions never leave a component of the unguarded pairs, so each component is one group, and its result the same as
    that of one list of all pairs (by probability, then ids).
    """
    ship(people.sparkSession)
    label = components(pairs, people)
    named = guard(people).join(label, "id")
    rows = pairs.join(label.withColumnRenamed("id", "id_l"), "id_l").select("component", "id_l", "id_r", "probability").withColumn("surname", F.lit(None).cast("string"))
    alone = named.select("component", F.col("id").alias("id_l"), F.lit(None).cast(dict(people.dtypes)["id"]).alias("id_r"), F.lit(None).cast("double").alias("probability"), "surname")
    kind = dict(people.dtypes)["id"]

    def union(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["id_r"].isna()]
        root = {x: x for x in own["id_l"]}
        name = {x: None if pd.isna(s) else s for x, s in zip(own["id_l"], own["surname"])}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        linked = frame[frame["id_r"].notna()].sort_values(["probability", "id_l", "id_r"], ascending=[False, True, True])
        for a, b in zip(linked["id_l"], linked["id_r"]):
            a, b = find(a), find(b)
            if a != b and (name[a] is None or name[b] is None or name[a] == name[b]):
                low, high = min(a, b), max(a, b)
                root[high], name[low] = low, name[low] or name[high]
        return pd.DataFrame({"id": list(root), "cluster": [find(x) for x in root]})

    return rows.unionByName(alone).groupBy("component").applyInPandas(union, f"id {kind}, cluster {kind}")


def surname_violations(clusters: DataFrame, people: DataFrame) -> DataFrame:
    """Clusters with more than one surname; there must be none."""
    return clusters.join(guard(people), "id").groupBy("cluster").agg(F.count_distinct("surname").alias("surnames")).where("surnames > 1")


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """canonical_id, entity_type, canonical_name, aliases, emails, mention_count, source_types for each cluster of
    mentions (cluster, entity_type, surface, source, ord).

    The name is the best surface: proper, of several words, no address, frequent, long, early. Aliases are distinct in
    order. A cluster is a bot if all of it is.
    """
    freq = mentions.groupBy("cluster", "surface").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    mail = F.col("surface").rlike(f"^{T.EMAIL}$")
    proper = F.col("surface").rlike(r"^[A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){0,3}$")
    rank = F.struct((~proper).alias("a"), (~F.col("surface").contains(" ")).alias("b"), mail.alias("c"), (-F.col("n")).alias("n"), (-F.length("surface")).alias("d"), "ord")
    surfaces = F.transform(F.array_sort(F.collect_list(F.struct("ord", "surface"))), lambda x: x["surface"])
    names = freq.groupBy("cluster").agg(F.min_by("surface", rank).alias("canonical_name"), surfaces.alias("aliases"))
    facts = mentions.groupBy("cluster").agg(F.count("*").cast("int").alias("mention_count"), F.array_sort(F.collect_set("source")).alias("source_types"), F.when(F.every(F.col("entity_type") == "bot"), "bot").otherwise(F.min(F.when(F.col("entity_type") != "bot", F.col("entity_type")))).alias("entity_type"))
    out = names.join(facts, "cluster").withColumn("canonical_id", T.mint_id("c", F.col("entity_type"), F.col("cluster").cast("string")))
    return out.withColumn("emails", F.filter("aliases", lambda x: x.rlike(f"^{T.EMAIL}$")))


def by_key(mentions: DataFrame) -> DataFrame:
    """Clusters of types that are told apart by their normalized surface; documents by doc_id."""
    key = F.when(F.col("entity_type") == "document", F.col("doc_id").cast("string")).otherwise(T.normalize_name(F.col("surface")))
    return mentions.withColumn("canonical_id", T.mint_id("c", F.col("entity_type"), key))


def disambiguated(names: DataFrame, candidates: DataFrame, context: DataFrame) -> DataFrame:
    """group, name, id: the one candidate of a name that the group's context has, or its only candidate."""
    met = names.join(candidates, "name").join(context.withColumn("_here", F.lit(1)), ["group", "id"], "left")
    one = met.groupBy("group", "name").agg(F.count("_here").alias("hits"), F.count("*").alias("all"), F.max(F.when(F.col("_here") == 1, F.col("id"))).alias("hit"), F.max("id").alias("only"))
    return one.where("hits = 1 OR all = 1").select("group", "name", F.when(F.col("hits") == 1, F.col("hit")).otherwise(F.col("only")).alias("id"))
