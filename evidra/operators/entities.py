"""Entities and relationships: who is who, and what calls, reads, runs on and retries what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import scores, text
from evidra.plans.lineage import stored

# An entity id's prefix gives its kind and its confidence as a mere hint.
PREFIX_KINDS = {
    "service": "service", "instance": "instance", "db": "database", "cache": "cache", "infra": "cache", "queue": "queue", "host": "host",
    "pod": "pod", "route": "route", "shard": "shard", "tenant": "tenant", "external-api": "external_api", "user": "tenant", "type": "route", "bucket": "shard",
}


def kind_of(entity: Column) -> Column:
    prefix = F.substring_index(entity, ":", 1)
    table = F.create_map(*[F.lit(x) for kv in PREFIX_KINDS.items() for x in kv])
    return F.when(entity.contains(":") & ~entity.contains("("), F.element_at(table, prefix))


def dependency_of(system: Column, cluster: Column, name: Column) -> Column:
    """The entity of a database resource: a clustered redis is infrastructure, any other is a database of its name."""
    return F.when(system.isNotNull() & name.isNotNull(), F.concat(F.when((system == "redis") & cluster.isNotNull(), "infra:").otherwise("db:"), name))


def service_confidence(version: Column, instance: Column, namespace: Column) -> Column:
    """How sure a service is that its resource names by version, instance and namespace."""
    told = version.isNotNull()
    return F.when(told & (instance.isNotNull() | namespace.isNotNull()), 0.99).when(told, 0.98).when(instance.isNotNull() | namespace.isNotNull(), 0.95).otherwise(0.90)


def shared_names(resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per service name: how many resources carry it, how many of them tell a version, the latest version and how many are rolled out as canaries."""
    rolled = F.count_if(F.col("rollout") == "canary") if "rollout" in resources.columns else F.lit(0).cast("long")
    return resources.where("service_name is not null").groupBy(*by, "service_name").agg(F.count("*").alias("_n"), F.count("version").alias("_told"), F.max("version").alias("_latest"), rolled.alias("_rolled"))


_AMBIGUOUS = "_n > 1 and _told between 1 and _n - 1"


def ambiguous_services(resources: DataFrame) -> DataFrame:
    """Service names that several resources share of which some carry a version and some do not."""
    return shared_names(resources).where(_AMBIGUOUS).select("service_name", F.col("_n").alias("n_resources"))


def with_roles(resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``resources`` with the ``role`` of those whose service name is ambiguous: canary (rolled out as one, else the latest version), stable (other versions), unresolved (no version)."""
    j = resources.join(shared_names(resources, by), [*by, "service_name"], "left")
    canary = F.col("rollout") == "canary" if "rollout" in resources.columns else F.lit(False)
    role = F.when(canary, "canary").when(F.col("version").isNull(), "unresolved").when((F.col("_rolled") == 0) & (F.col("version") == F.col("_latest")), "canary").otherwise("stable")
    return j.withColumn("role", F.when(F.expr(_AMBIGUOUS), role)).drop("_n", "_told", "_latest", "_rolled")


def role_confidence(role: Column) -> Column:
    """How sure the entity of an ambiguous service's role is; null without a role."""
    return F.when(role == "canary", 0.96).when(role == "stable", 0.95).when(role == "unresolved", 0.40)


def split_ambiguous(resources: DataFrame) -> DataFrame:
    """Entities of ambiguous services, one per role."""
    g = with_roles(resources).where("role is not null").groupBy("service_name", "role").agg(F.count("*").alias("n_resources"))
    return g.select(F.concat(F.lit("service:"), "service_name", F.lit("@"), "role").alias("entity"), "role", "n_resources", role_confidence(F.col("role")).alias("confidence"))


def unresolved_share(records: DataFrame, entity: Column) -> DataFrame:
    """Share of records that mention each unresolved entity, to two decimals; none is absent."""
    total = records.agg(F.count("*").alias("n_all"))
    n = records.where(entity.isNotNull()).groupBy(entity.alias("entity")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("entity", F.round(F.col("n") / F.col("n_all"), 2).alias("share"))


def merge_entities(found: DataFrame) -> DataFrame:
    """Rows of one entity id (id, kind, source, confidence, seq) as one: union of sources in order, the greatest confidence of the first kind.

    Each source of a kind is kept once, with its least place, before an entity's sources are gathered: many spans name one resource.
    """
    each = found.groupBy("id", "kind", "source").agg(F.min("seq").alias("seq"), F.max("confidence").alias("confidence"))
    sources = F.collect_list(F.struct("seq", "source"))
    kinds = each.groupBy("id", "kind").agg(F.min("seq").alias("seq"), F.max("confidence").alias("confidence"), sources.alias("_s"))
    g = kinds.groupBy("id").agg(F.min_by(F.struct("kind", "confidence"), "seq").alias("_first"), F.flatten(F.collect_list("_s")).alias("_s"))
    return g.select("id", "_first.kind", "_first.confidence", F.array_distinct(F.transform(F.array_sort("_s"), lambda x: x["source"])).alias("sources"))


#: How sure an edge of each origin is.
CALL, WRITE, CACHE_READ, MISS_READ, READ, EXTERNAL, LOGICAL, DEPLOYED, RUNS_ON, INFERRED, SHARED = 0.98, 0.96, 0.97, 0.96, 0.97, 0.95, 0.90, 0.99, 0.95, 0.95, 0.80


def edge_rows(df: DataFrame, src: Column, kind: Column | str, dst: Column, confidence: Column | float, evidence: Column, attributes: Column | None = None, seq: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, src, type, dst, confidence, evidence, attributes, seq) for :func:`merge_edges`; those without an end, or from a thing to itself, go."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = df.select(
        *by, src.alias("src"), lit(kind).alias("type"), dst.alias("dst"), lit(confidence).cast("double").alias("confidence"), evidence.cast("string").alias("evidence"),
        lit(attributes).cast("string").alias("attributes"), lit(0 if seq is None else seq).cast("long").alias("seq"),
    )
    return made.where("src is not null and dst is not null and src <> dst")


def merge_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of one edge (by, src, type, dst) as one: greatest confidence, evidence in order without repeats, first attributes.

    Each piece of evidence is kept once, with its least place, before an edge's evidence is gathered.
    """
    keys = [*by, "src", "type", "dst"]
    attributes = F.min(F.struct("seq", "attributes")) if "attributes" in edges.columns else F.lit(None)
    each = edges.groupBy(*keys, "evidence").agg(F.max("confidence").alias("confidence"), F.min("seq").alias("seq"), attributes.alias("_a"))
    g = each.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"]).alias("evidence"), F.min("_a").alias("_a"))
    return g.withColumn("evidence", F.array_compact("evidence")).withColumn("attributes", F.col("_a.attributes") if "attributes" in edges.columns else F.lit(None).cast("string")).drop("_a")


def edge_confidence(edges: DataFrame, entities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges with their confidence lowered where an endpoint is uncertain."""
    e = entities.select(*by, "id", "confidence")
    s, d = e.withColumnsRenamed({"id": "src", "confidence": "_s"}), e.withColumnsRenamed({"id": "dst", "confidence": "_d"})
    return edges.join(s, [*by, "src"], "left").join(d, [*by, "dst"], "left").withColumn("confidence", scores.damped_edge(F.col("confidence"), F.col("_s"), F.col("_d"))).drop("_s", "_d")


def nearest_service(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, ancestor_id, depth, ancestor): for each span the nearest ancestor that is a service.

    Pointer doubling: each round joins a span to where its ancestor points, so the reach doubles and a trace of n spans
    takes log2 n rounds, however deep it is.  What is open after that many lies on a cycle of parents and has no ancestor.
    A row that has found its ancestor carries its name and is stored once; a round stores only what was open before it.
    """
    hit = F.col("endpoint") == "service"
    node = spans.select("trace_id", F.col("span_id").alias("at"), hit.alias("hit"), F.when(hit, F.col("entity")).alias("ancestor"))
    up = stored(spans.select("trace_id", "span_id", F.col("parent_id").alias("at")).join(node, ["trace_id", "at"]).select("trace_id", "span_id", "at", F.lit(1).alias("depth"), "hit", "ancestor"))
    done, left = up.where("hit"), up.where("not hit")
    # An ancestor beyond the next span is reached over open rows of its trace only.
    longest = left.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    for _ in range(int(longest).bit_length()):
        step = done.unionByName(left).select("trace_id", F.col("span_id").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.col("hit").alias("there"), F.col("ancestor").alias("name"))
        further = left.drop("hit", "ancestor").join(step, ["trace_id", "at"]).select("trace_id", "span_id", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("hit"), F.col("name").alias("ancestor"))
        further = stored(further)
        done, left = done.unionByName(further.where("hit")), further.where("not hit")
        if left.isEmpty():
            break
    return done.select("trace_id", "span_id", F.col("at").alias("ancestor_id"), "depth", "ancestor")


def with_ancestors(spans: DataFrame) -> DataFrame:
    """``spans`` with their nearest service ``ancestor``, null without one: what :func:`call_rows` and :func:`access_rows` then read without a join of their own."""
    return spans.join(nearest_service(spans).select("trace_id", "span_id", "ancestor"), ["trace_id", "span_id"], "left")


def _called(spans: DataFrame, ancestors: DataFrame | None) -> DataFrame:
    """Spans, as :func:`_placed`, with the ancestor that is given or that they carry."""
    return _placed(spans) if ancestors is None else _placed(spans).join(ancestors.select("trace_id", "span_id", "ancestor"), ["trace_id", "span_id"])


def call_rows(spans: DataFrame, ancestors: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Calls from the nearest service ancestor to another entity, one row a span."""
    own = _called(spans, ancestors)
    return edge_rows(own, F.col("ancestor"), "calls", F.col("entity"), CALL, F.col("_ref"), seq=F.col("_seq"), by=by)


def call_edges(spans: DataFrame, ancestors: DataFrame) -> DataFrame:
    return merge_edges(call_rows(spans, ancestors))


def _placed(spans: DataFrame) -> DataFrame:
    """Spans with the reference and the place of their evidence: those they carry, else their id."""
    there = set(spans.columns)
    return spans.withColumns({"_ref": F.col("ref" if "ref" in there else "span_id").cast("string"), "_seq": F.col("seq" if "seq" in there else "span_id").cast("long")})


def access_rows(spans: DataFrame, ancestors: DataFrame | None = None, misses: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Reads and writes of dependencies, one row a span.

    A statement (or a name) that writes makes a write.  ``misses`` are the spans beside a cache miss: an access of a database there is
    marked as a fallback, and a read there (but not of a cache) is a little less sure.  Without ``misses`` the spans carry it (:func:`beside_misses`).
    """
    j = _called(spans.where("endpoint = 'dependency'"), ancestors)
    j = j if misses is None else j.join(misses.select("trace_id", "span_id", F.lit(True).alias("_miss")), ["trace_id", "span_id"], "left")
    names = [F.col(c) for c in ("statement", "name") if c in spans.columns]
    write, beside = text.is_write(F.coalesce(*names, F.lit(""))), F.coalesce("_miss", F.lit(False))
    sure = F.when(write, WRITE).when(F.col("entity").rlike("^(cache|infra):"), CACHE_READ).when(beside, MISS_READ).otherwise(READ)
    role = F.when(F.col("entity").startswith("db:") & beside, "cache-miss-fallback")
    return edge_rows(j, F.col("ancestor"), F.when(write, "writes-to").otherwise("reads-from"), F.col("entity"), sure, F.col("_ref"), role, F.col("_seq"), by)


def access_edges(spans: DataFrame, ancestors: DataFrame, misses: DataFrame) -> DataFrame:
    return merge_edges(access_rows(spans, ancestors, misses))


def with_miss_sibling(spans: DataFrame, misses: DataFrame) -> DataFrame:
    """Spans with a sibling that missed the cache: same trace and parent, where no parent equals no parent."""
    m = misses.select(F.col("trace_id").alias("_t"), F.col("parent_id").alias("_p"), F.col("span_id").alias("_s"))
    return spans.join(m, (spans["trace_id"] == m["_t"]) & spans["parent_id"].eqNullSafe(m["_p"]) & (spans["span_id"] != m["_s"]), "left_semi")


def beside_misses(spans: DataFrame, misses: DataFrame) -> DataFrame:
    """``spans`` with ``_miss``: whether a sibling missed the cache, as :func:`with_miss_sibling`.

    The least and the greatest span that missed tell of a parent whether one other than the span itself did.
    """
    m = misses.groupBy(F.col("trace_id").alias("_t"), F.col("parent_id").alias("_p")).agg(F.min("span_id").alias("_a"), F.max("span_id").alias("_b"))
    j = spans.join(m, (spans["trace_id"] == m["_t"]) & spans["parent_id"].eqNullSafe(m["_p"]), "left")
    return j.withColumn("_miss", F.coalesce((F.col("_a") != F.col("span_id")) | (F.col("_b") != F.col("span_id")), F.lit(False))).drop("_t", "_p", "_a", "_b")


def retry_edges(attempts: DataFrame, least: int = 2) -> DataFrame:
    """(trace_id, src, dst) with at least so many tries, or one numbered so high."""
    g = attempts.groupBy("trace_id", "src", "dst").agg(F.count("*").alias("n"), F.max("attempt").alias("max_attempt"))
    return g.where((F.col("n") >= least) | (F.col("max_attempt") >= least)).withColumn("confidence", F.lit(0.95))


def sharing(reads: DataFrame, writes: DataFrame, by: Sequence[str] = (), least: float = WRITE) -> DataFrame:
    """(by, src, other, dst): readers and certain writers of one thing, each side made distinct first."""
    r = reads.select(*by, "src", "dst").distinct()
    w = writes.where(F.col("confidence") >= least).select(*by, F.col("src").alias("other"), "dst").distinct()
    return r.join(w, [*by, "dst"]).where("src <> other")


def shared_resource_edges(reads: DataFrame, writes: DataFrame, least: float = WRITE) -> DataFrame:
    """(src, other, n_shared): how many things two entities share."""
    return sharing(reads, writes, (), least).groupBy("src", "other").agg(F.count("*").alias("n_shared"))


def instances(resources: DataFrame) -> DataFrame:
    """``resources`` with the number of resources that share their service name."""
    n = resources.groupBy("service_name").agg(F.count("*").alias("n_instances"))
    return resources.join(n, "service_name")


def by_name(resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, service_name, dst): the entity of the first resource of each name."""
    return resources.where("service_name is not null").groupBy(*by, "service_name").agg(F.min_by("entity", "seq").alias("dst"))


def named_pair_rows(resources: DataFrame, evidence: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """User interfaces call the API of their name: x-ui calls x-api."""
    ui = resources.where(F.col("service_name").endswith("-ui")).withColumn("_e", F.col("service_name") if evidence is None else evidence).withColumn("service_name", F.regexp_replace("service_name", "-ui$", "-api"))
    return edge_rows(ui.join(by_name(resources, by), [*by, "service_name"]), F.col("entity"), "calls", F.col("dst"), INFERRED, F.col("_e"), by=by)


def named_pairs(resources: DataFrame) -> DataFrame:
    return merge_edges(named_pair_rows(resources))


def trigger_rows(priors: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """An earlier incident (prior_id, primary_entity, trigger) whose trigger begins with a service and a space: that service writes to its database, if ``names`` (by, service_name) has it."""
    there = names.where("service_name is not null").select(*by, F.concat(F.lit("db:"), "service_name").alias("primary_entity")).distinct()
    first = F.substring_index("trigger", " ", 1)
    own = priors.where(first.startswith("service:") & F.col("trigger").contains(" ")).join(there, [*by, "primary_entity"], "left_semi")
    return edge_rows(own, first, "writes-to", F.col("primary_entity"), INFERRED, F.col("prior_id"), by=by)


def trigger_edges(priors: DataFrame, names: DataFrame) -> DataFrame:
    return merge_edges(trigger_rows(priors, names))


def runtime_rows(resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a resource (resource_id, entity, endpoint, instance, pod, host) tells of where it runs: a service is deployed as instances and pods, a pod runs on a host."""
    c = F.col
    name = lambda kind: F.concat(F.lit(f"{kind}:"), c(kind))
    own = resources.where("endpoint = 'service'")
    rows = [(own, c("entity"), "deployed-as", name("instance"), CALL, c("seq")), (own, c("entity"), "deployed-as", name("pod"), DEPLOYED, c("seq")), (resources, name("pod"), "runs-on", name("host"), RUNS_ON, None)]
    out = [edge_rows(df, src, kind, dst, sure, c("resource_id"), seq=seq, by=by) for df, src, kind, dst, sure, seq in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


def gap_entities(gaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, kind, source): every entity that a gap (gap_id, entities) affects and whose prefix tells its kind."""
    own = gaps.select(*by, F.col("gap_id").alias("source"), F.explode("entities").alias("id"))
    return own.withColumn("kind", kind_of(F.col("id"))).where("kind is not null").select(*by, "id", "kind", "source").distinct()


def logical_rows(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a service's span says of itself (entity, shard, tenant: ids): a service fans out to its shards, a tenant calls it."""
    s = _placed(spans)
    routed = F.when(F.col("shard").isNotNull(), F.concat(F.lit("routed to "), "shard"))
    out = edge_rows(s, F.col("entity"), "fans-out-to", F.col("shard"), LOGICAL, F.col("_ref"), seq=F.col("_seq"), by=by)
    return out.unionByName(edge_rows(s, F.col("tenant"), "calls", F.col("entity"), LOGICAL, F.col("_ref"), routed, F.col("_seq"), by))


def logical_edges(spans: DataFrame) -> DataFrame:
    return merge_edges(logical_rows(spans))


def peers(spans: DataFrame, services: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(calls to known services, external peers): spans' ``peer`` joined to service names; the first service of a name counts."""
    named = spans.where(F.col("peer").isNotNull()).join(by_name(services, by).withColumnRenamed("service_name", "peer"), [*by, "peer"], "left")
    return named.where("dst is not null"), named.where("dst is null").withColumn("dst", F.concat(F.lit("external-api:"), "peer"))


def peer_rows(spans: DataFrame, services: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A service's span with a peer: a call of the service of that name, else a dependency on something outside, which a charge makes a payment provider."""
    known, outside = peers(_placed(spans), services, by)
    pays = F.when(F.lower("name").contains("charge"), "payment-provider")
    out = edge_rows(known, F.col("entity"), "calls", F.col("dst"), CALL, F.col("_ref"), seq=F.col("_seq"), by=by)
    return out.unionByName(edge_rows(outside, F.col("entity"), "depends-on", F.col("dst"), EXTERNAL, F.col("_ref"), pays, F.col("_seq"), by))


def named_in_text(changes: DataFrame, stems: DataFrame, by: Sequence[str] = (), split: str = r"[^a-z0-9]+") -> DataFrame:
    """The first stem (by seq) that stands as a word of each change's text: (by, change_id, stem).

    Words are exploded and matched on equality, so the work follows the length of the texts.
    """
    words = changes.select(*by, "change_id", F.explode(F.array_distinct(F.split(F.lower("summary"), split))).alias("stem")).where("stem <> ''")
    return words.join(stems, [*by, "stem"]).groupBy(*by, "change_id").agg(F.min_by("stem", F.struct("seq", "stem")).alias("stem"))


def cleanup_rows(changes: DataFrame, resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A clean-up that a service runs and whose text names a database (with or without -pg) writes to it; the first database so named counts."""
    c = F.col
    name = F.lower("service_name")
    stems = resources.where("endpoint = 'dependency' and entity like 'db:%' and service_name is not null").select(*by, "seq", c("entity").alias("db"), F.explode(F.array_distinct(F.array(name, F.regexp_replace(name, "-pg$", "")))).alias("stem"))
    first = stems.groupBy(*by, "stem").agg(F.min("seq").alias("seq"), F.min_by("db", F.struct("seq", "db")).alias("db"))
    own = changes.where(c("entity").startswith("service:") & F.lower("summary").contains("vacuum"))
    named = named_in_text(own, first, by, r"[^a-z0-9_-]+").join(first.select(*by, "stem", "db"), [*by, "stem"])
    j = own.join(named, [*by, "change_id"]).withColumn("service_name", text.service_name(c("entity"))).join(by_name(resources.where("endpoint = 'service'"), by), [*by, "service_name"], "left")
    return edge_rows(j, F.coalesce("dst", "entity"), "writes-to", c("db"), INFERRED, c("change_id"), by=by)


def discriminator(values: Column) -> Column:
    """One distinct value as a JSON scalar, several as a sorted JSON array, none as null (an aggregate expression)."""
    own = F.array_sort(F.collect_set(values))
    return F.when(F.size(own) == 1, F.to_json(own).substr(F.lit(2), F.length(F.to_json(own)) - 2)).when(F.size(own) > 1, F.to_json(own))
