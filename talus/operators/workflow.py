"""From a triage decision to a dossier and a human decision, as projections over many alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus import config
from talus.functions.dates import brasilia_date, deadlines, is_weekend
from talus.schemas import MODEL_OUTPUT


def expanded_output(text: Column) -> Column:
    """The model's short-key answer as a struct; null unless the text is one object, with exactly the keys t, c, r, e (once each) and allowed values."""
    got = F.from_json(text, MODEL_OUTPUT)
    keys = F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in "cert"])
    whole = F.regexp_like(text, F.lit(r'"e"\s*:\s*\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]'))
    alone = F.regexp_like(text, F.lit(r"^\s*\{[^{}]*\}\s*$"))  # nothing before or after: allowed values hold no braces
    ok = (
        alone & keys & whole & got["t"].isin(config.TYPOLOGIES) & got["r"].isin(config.RECOMMENDATIONS) & got["c"].between(0.0, 1.0)
        & (F.size(got["e"]) <= 3) & F.forall(got["e"], lambda x: x >= 1)
    )
    ids = F.transform(got["e"], lambda x: F.format_string("F%02d", x))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(got["t"].alias("typology"), got["c"].alias("confidence"), got["r"].alias("recommendation"), ids.alias("evidence")))


def generation_schema(feature_ids: list[str]) -> dict:
    """JSON schema for the model's answer: evidence only from the features that exist."""
    numbers = sorted(int(x[1:]) for x in feature_ids)
    properties = {
        "t": {"type": "string", "enum": config.TYPOLOGIES}, "c": {"type": "number", "minimum": 0, "maximum": 1}, "r": {"type": "string", "enum": config.RECOMMENDATIONS},
        "e": {"type": "array", "items": {"type": "integer", "enum": numbers}, "maxItems": 3},
    }
    return {"type": "object", "properties": properties, "required": list("tcre"), "additionalProperties": False}


def first_valid(attempts: DataFrame, most: int = 3) -> DataFrame:
    """alert_id, output, attempts, state: the first valid answer (alert_id, attempt, answer) of at most three, else NEEDS_HUMAN."""
    rows = attempts.where(F.col("attempt") <= most).withColumn("output", expanded_output(F.col("answer")))
    best = rows.groupBy("alert_id").agg(F.min(F.when(F.col("output").isNotNull(), F.struct("attempt", "output"))).alias("b"), F.max("attempt").alias("last"))
    return best.select("alert_id", F.col("b.output").alias("output"), F.coalesce("b.attempt", "last").alias("attempts"), F.when(F.col("b").isNull(), F.lit("NEEDS_HUMAN")).otherwise(F.lit("INVESTIGATING")).alias("state"))


def missing_evidence(evidence: Column, known: Column) -> Column:
    """Evidence ids that no feature has, in order, repeats kept."""
    return F.filter(evidence, lambda e: ~F.array_contains(known, e))


def evidence_features(outputs: DataFrame, features: DataFrame) -> DataFrame:
    """alert_id, evidence: feature rows in the answer's order; unknown ids are left out."""
    asked = outputs.select("alert_id", F.posexplode("evidence").alias("pos", "feature_id"))
    found = asked.join(features, ["alert_id", "feature_id"])
    item = F.struct("pos", "feature_id", "name", "value_int", "value_str")
    return found.groupBy("alert_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def guarded(rows: DataFrame) -> DataFrame:
    """rows (recommendation, typology, fired_rules) with state and failure_reason: filing away a critical case needs a human."""
    critical = F.array(*[F.lit(t) for _, t, _, c in config.SUSPICIOUS if c])
    against = (F.col("recommendation") == "ARQUIVAR") & ((F.size("fired_rules") > 0) | F.array_contains(critical, F.col("typology")))
    return rows.withColumn("state", F.when(against, F.lit("NEEDS_HUMAN")).otherwise(F.lit("RESEARCHING"))).withColumn("failure_reason", F.when(against, F.lit("ARQUIVAR against a critical detector or typology")))


def routed(rows: DataFrame) -> DataFrame:
    """rows (node, state, level) with ``next_node``: NEEDS_HUMAN to the handoff, triage by level, else the line's next node."""
    line = F.create_map(*[F.lit(x) for a, b in (("sanitizer", "triage"), ("investigation", "retrieval"), ("retrieval", "selection"), ("selection", "reviewer"), ("reviewer", "dossier"), ("dossier", "end")) for x in (a, b)])
    by_level = F.when(F.col("level") == "INVESTIGAR", F.lit("investigation")).otherwise(F.lit("dossier"))
    return rows.withColumn("next_node", F.when(F.col("state") == "NEEDS_HUMAN", F.lit("human_handoff")).when(F.col("node") == "triage", by_level).otherwise(F.try_element_at(line, F.col("node"))))


def envelope_violations(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """messages (from_node, to_node, message_type, schema, alert_id, payload_alert_id) with ``violations``. 14 edges."""
    side = F.broadcast(edges.select("from_node", "to_node", F.col("message_type").alias("_type"), F.col("schema").alias("_schema")))
    checks = F.array(
        F.when(F.col("_type").isNull(), F.lit("no such edge")), F.when(F.col("_type") != F.col("message_type"), F.lit("wrong message type")),
        F.when(F.col("_schema") != F.col("schema"), F.lit("wrong schema")), F.when(~F.equal_null("alert_id", "payload_alert_id"), F.lit("payload of another alert")),
    )
    return messages.join(side, ["from_node", "to_node"], "left").withColumn("violations", F.filter(checks, lambda v: v.isNotNull())).drop("_type", "_schema")


def record_violations(records: DataFrame) -> DataFrame:
    """records (state, triage_level, failure_reason, start, end, amount) with ``violations`` of the contracts."""
    before = ["RECEIVED", "SANITIZED"]
    level = F.col("triage_level")
    checks = F.array(
        F.when(~F.col("state").isin(config.STATES), F.lit("unknown state")),
        F.when(F.col("start") > F.col("end"), F.lit("window ends before it starts")),
        F.when(~(F.col("amount") > 0), F.lit("amount not positive")),
        F.when((F.col("state") == "NEEDS_HUMAN") != F.col("failure_reason").isNotNull(), F.lit("failure reason exactly with NEEDS_HUMAN")),
        F.when(F.col("state").isin(before) & level.isNotNull(), F.lit("level before triage")),
        F.when(~F.col("state").isin([*before, "NEEDS_HUMAN"]) & level.isNull(), F.lit("no level after triage")),
        F.when(F.col("state").isin("INVESTIGATING", "RESEARCHING", "REVIEWING") & (level != "INVESTIGAR"), F.lit("investigated without cause")),
    )
    return records.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))


def event_violations(events: DataFrame) -> DataFrame:
    """Audit events with ``violations``: key prefix, first event's link, model fields all or none, tokens only with a model."""
    model = [F.col(c).isNotNull() for c in ("model_id", "prompt_sha256", "prompt_version")]
    n = sum((m.cast("int") for m in model[1:]), model[0].cast("int"))
    checks = F.array(
        F.when(~F.startswith("event_key", "alert_id"), F.lit("event_key does not begin with the alert")),
        F.when((F.col("seq") == 1) != F.col("prev_hash").isNull(), F.lit("prev_hash null exactly for the first")),
        F.when(n.isin(1, 2), F.lit("model fields incomplete")),
        F.when((F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull()) & F.col("model_id").isNull(), F.lit("tokens without model")),
    )
    return events.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))


def dossiers(triage: DataFrame, outputs: DataFrame, citations: DataFrame) -> DataFrame:
    """alert_id, dossier_type, state, summary, recommendation, typology, failure_reason, deadlines.

    triage: alert_id, level, rules_version, selected_at; outputs: alert_id, typology,
    confidence, recommendation; citations: alert_id, n_verified. Without an
    investigation the alert is filed away by template; a report without a
    verified citation needs a human, as does an inconclusive answer.
    """
    filed = triage.where("level = 'PROPOR_ARQUIVAMENTO'").select(
        "alert_id", F.lit("ARQUIVAMENTO").alias("dossier_type"), F.lit("DRAFT_READY").alias("state"),
        F.format_string("Arquivamento proposto pela triagem determinística (rules_version %d): nenhum detector crítico disparado.", "rules_version").alias("summary"),
        F.lit("ARQUIVAR").alias("recommendation"), F.lit(None).cast("string").alias("typology"), F.lit(None).cast("string").alias("failure_reason"), *deadlines(F.col("selected_at")),
    )
    rows = triage.where("level = 'INVESTIGAR'").join(outputs, "alert_id").join(citations.select("alert_id", "n_verified"), "alert_id", "left").fillna(0, ["n_verified"])
    reason = F.when(F.col("recommendation") == "INCONCLUSIVO", F.lit("INCONCLUSIVO gives no dossier")).when((F.col("recommendation") == "COMUNICAR") & (F.col("n_verified") == 0), F.lit("a report needs a verified citation"))
    kind = F.when(F.col("recommendation") == "COMUNICAR", F.lit("COS")).otherwise(F.lit("ARQUIVAMENTO"))
    summary = F.format_string("Recomendação %s: hipótese %s, confiança %.2f, %d citação(ões) verificada(s).", "recommendation", "typology", "confidence", "n_verified")
    investigated = rows.select(
        "alert_id", F.when(reason.isNull(), kind).alias("dossier_type"), F.when(reason.isNull(), F.lit("DRAFT_READY")).otherwise(F.lit("NEEDS_HUMAN")).alias("state"), F.when(reason.isNull(), summary).alias("summary"),
        "recommendation", "typology", reason.alias("failure_reason"), *deadlines(F.col("selected_at")),
    )
    return filed.unionByName(investigated)


def markdown(dossier: DataFrame) -> DataFrame:
    """alert_id, text: a dossier (with optional arrays ``evidence`` and ``quotes``) as Markdown."""
    lines = lambda c, f: F.array_join(F.transform(c, f), "\n")
    evidence = lines("evidence", lambda e: F.concat(F.lit("- "), e["feature_id"], F.lit(" "), e["name"], F.lit(": "), F.coalesce(e["value_str"], e["value_int"].cast("string")))) if "evidence" in dossier.columns else F.lit(None)
    quotes = lines("quotes", lambda q: F.concat(F.lit("> "), q["article_ref"], F.lit(": "), q["quoted_text"])) if "quotes" in dossier.columns else F.lit(None)
    title = F.when(F.col("dossier_type") == "COS", F.lit("# Comunicação de operação suspeita")).otherwise(F.lit("# Arquivamento"))
    due = F.concat(F.lit("Prazo interno: "), F.date_format("prazo_interno", "yyyy-MM-dd"), F.lit("; regulatório: "), F.date_format("prazo_regulatorio", "yyyy-MM-dd"))
    return dossier.where("state = 'DRAFT_READY'").select("alert_id", F.concat_ws("\n\n", title, "summary", evidence, quotes, due).alias("text"))


def decided(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions with ``accepted`` and the alert's new state: one for each alert that has a draft, with at least 50 characters of reason.

    decisions: alert_id, decision, justification, decided_at; of several the earliest counts.
    """
    state = F.create_map(*[F.lit(x) for pair in {"COMUNICAR": "APPROVED", "ARQUIVAR": "APPROVED", "DEVOLVER": "RETURNED"}.items() for x in pair])
    first = decisions.groupBy("alert_id").agg(F.min(F.struct("decided_at", "decision", "justification")).alias("d")).select("alert_id", "d.*")
    rows = first.join(records.select("alert_id", F.col("state").alias("from_state")), "alert_id", "left")
    ok = F.col("from_state").isin("DRAFT_READY", "SUBMITTED") & (F.length(F.trim("justification")) >= 50) & F.try_element_at(state, F.col("decision")).isNotNull()
    accepted = F.coalesce(ok, F.lit(False))
    return rows.withColumn("accepted", accepted).withColumn("state", F.when(accepted, F.try_element_at(state, F.col("decision"))).otherwise(F.col("from_state")))


def reporting_day_violations(decisions: DataFrame, calendar: DataFrame) -> DataFrame:
    """decisions (decided_at, prazo_comunicacao) with ``valid``: the next business day after the decision's day in Brasília, which is no weekend."""
    from talus.functions.dates import next_business_day

    rows = next_business_day(decisions.withColumn("_on", brasilia_date(F.col("decided_at"))), "_on", calendar)
    return rows.withColumn("valid", (F.col("prazo_comunicacao") == F.col("next_business")) & ~is_weekend(F.col("prazo_comunicacao"))).drop("_on", "next_business")


def new_alerts(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """arriving with ``status``: created, repeated (same payload) or conflict (another payload under a known id)."""
    old = known.select("alert_id", F.col("payload_sha256").alias("_sha"))
    first = arriving.groupBy("alert_id").agg(F.min("payload_sha256").alias("payload_sha256"), F.max("payload_sha256").alias("_most"))
    rows = first.join(old, "alert_id", "left")
    status = F.when((F.col("payload_sha256") != F.col("_most")) | (F.col("_sha") != F.col("payload_sha256")), F.lit("conflict")).when(F.col("_sha").isNotNull(), F.lit("repeated")).otherwise(F.lit("created"))
    return rows.select("alert_id", "payload_sha256", status.alias("status"))


def typology_incisos(typologies: DataFrame, labels: DataFrame) -> DataFrame:
    """typologies (typology) with its label, incisos and whether it is critical; null for NENHUMA. 17 labels."""
    side = labels.where("typology IS NOT NULL").select("typology", F.col("label").alias("source_label"), "incisos", "critical")
    known = typologies.where(F.col("typology").isin(config.TYPOLOGIES) | F.col("typology").isNull()).join(F.broadcast(side), "typology", "left")
    unknown = typologies.where(~F.col("typology").isin(config.TYPOLOGIES)).count()
    if unknown:
        raise ValueError(f"{unknown} rows of an unknown typology")
    return known


def duplicates(items: Column) -> Column:
    """The items of an array that occur more than once, each once, in order of first appearance."""
    return F.filter(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)) > 1)


def disjoint_violations(verdict_rows: DataFrame) -> DataFrame:
    """verdict rows (alert_id, verified and rejected arrays of chunk ids) with ``violations``: ids on both sides, ids given twice."""
    both = F.array_intersect("verified", "rejected")
    checks = F.array(
        F.when(F.size(both) > 0, F.concat(F.lit("verified and rejected: "), F.array_join(both, ","))),
        F.when(F.size(duplicates(F.concat("verified", "rejected"))) > F.size(both), F.lit("given twice")),
    )
    return verdict_rows.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))


def node_step(records: DataFrame, node: str, outcomes: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """One node over all alerts that stand before it: (records afterwards, audit events).

    records: alert_id, node (the next one), state, level, failure_reason, occurred_at;
    outcomes: alert_id, attempt, state, level, error (null: the attempt succeeded),
    occurred_at. The first success among the first ``most`` attempts counts. Without
    one the alert fails closed: NEEDS_HUMAN with the last error. Each attempt that
    was used gives an event under its node key, so a step that runs again gives the
    same keys and an append refuses them. Records of other nodes stay as they are.
    """
    tried = outcomes.where(F.col("attempt") <= most)
    good = F.min(F.when(F.col("error").isNull(), F.struct("attempt", "state", "level", "occurred_at")))
    bad = F.max(F.when(F.col("error").isNotNull(), F.struct("attempt", "error", "occurred_at")))
    best = tried.groupBy("alert_id").agg(good.alias("_good"), bad.alias("_bad"))
    here = records.where((F.col("node") == node) & (F.col("state") != "NEEDS_HUMAN"))
    ran = here.join(best, "alert_id", "left")
    failed = F.col("_good").isNull()
    after = ran.select(
        "alert_id", F.lit(node).alias("node"), F.when(failed, F.lit("NEEDS_HUMAN")).otherwise(F.col("_good.state")).alias("state"), F.when(failed, F.col("level")).otherwise(F.coalesce("_good.level", "level")).alias("level"),
        F.when(failed, F.coalesce("_bad.error", F.lit(f"{node}: no outcome"))).alias("failure_reason"), F.coalesce("_good.occurred_at", "_bad.occurred_at", "occurred_at").alias("occurred_at"),
    )
    moved = routed(after).withColumn("node", F.col("next_node")).select("alert_id", "node", "state", "level", "failure_reason", "occurred_at")
    rest = records.join(here.select("alert_id"), "alert_id", "left_anti").select(*moved.columns)
    used = tried.join(ran.select("alert_id", F.col("state").alias("state_from"), F.coalesce("_good.attempt", F.lit(most)).alias("_last")), "alert_id").where(F.col("attempt") <= F.col("_last"))
    kind = F.when(F.col("error").isNull(), F.lit("NODE_COMPLETED")).otherwise(F.lit("NODE_FAILED"))
    key = F.concat_ws("_", "alert_id", F.lit(node), F.col("attempt").cast("string"), kind)
    events = used.select("alert_id", key.alias("event_key"), "occurred_at", kind.alias("event_type"), F.lit(node).alias("actor"), "state_from", F.when(F.col("error").isNull(), F.col("state")).otherwise(F.col("state_from")).alias("state_to"))
    return moved.unionByName(rest), events


def run_nodes(records: DataFrame, outcomes: DataFrame, checkpoint, nodes: list[str] = config.NODES) -> tuple[DataFrame, DataFrame]:
    """All nodes in their order (outcomes with ``node``): final records and all events. checkpoint(df, name) stores a table and returns it read back, so that a run that broke off goes on from the last node."""
    events = None
    for node in nodes:
        records, own = node_step(records, node, outcomes.where(F.col("node") == node).drop("node"))
        records, own = checkpoint(records, f"records-{node}"), checkpoint(own, f"events-{node}")
        events = own if events is None else events.unionByName(own)
    return records, events


def to_records(final: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert records of final states (alert_id, state, level, failure_reason, occurred_at), with the alert's window, deadlines and ``violations`` of the contracts."""
    rows = final.join(alerts.select("alert_id", "account", "rule_id", "start", "end", "selected_at"), "alert_id").withColumnRenamed("level", "triage_level")
    checked = record_violations(rows.withColumn("amount", F.lit(1))).drop("amount")
    return checked.select("*", *deadlines(F.col("selected_at")), F.col("occurred_at").alias("updated_at")).drop("occurred_at")
