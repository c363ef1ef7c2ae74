"""Lifecycle machines as tables: states, transitions, validation, conformance.

states: machine, ord, name, description, confidence, is_terminal, category.
transitions: machine, source, target, trigger, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom import lookups
from clauseloom.functions.text import any_of, strip
from clauseloom.session import cut_lineage, scratch_path, stored

#: Characters of a prompt window, about, and clause numbers that are summed up together.
CONTEXT_LENGTH = 3000
CONTEXT_RANGE = 4096


# --- states and transitions -------------------------------------------------------------

def state_category(name: Column, description: Column) -> Column:
    low, expr = F.lower(F.concat_ws(" ", name, description)), None
    for kind, stems in lookups.CATEGORY_STEMS:
        cond = low.rlike(any_of(stems))
        expr = F.when(cond, kind) if expr is None else expr.when(cond, kind)
    return expr.otherwise(lookups.DEFAULT_CATEGORY)


def is_terminal_state(name: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, description)).rlike(any_of(lookups.TERMINAL_WORDS))


def normalized_states(raw: DataFrame) -> DataFrame:
    """Lower-case names with underscores, category, terminal flag and trigger words."""
    name = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    return raw.withColumn("name", name).withColumn("category", state_category(F.col("name"), F.col("description"))).withColumn(
        "is_terminal", F.coalesce("is_terminal", F.lit(False)) | is_terminal_state(F.col("name"), F.col("description")))


def trigger_words(evidence: Column) -> Column:
    """First three evidence words that contain an action stem."""
    hits = F.filter(F.split(F.lower(evidence), r"(?U)\s+"), lambda w: w.rlike(any_of(lookups.TRIGGER_STEMS)))
    return F.slice(hits, 1, 3)


def source_clauses(states: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clause types whose text holds one of the first three evidence words."""
    first = F.slice(F.filter(F.split(F.lower("evidence"), r"(?U)\s+"), lambda w: w != ""), 1, 3)
    wanted = states.select("contract_id", "name", first.alias("words"))
    hit = wanted.join(clauses.select("contract_id", "clause_type", F.lower("text").alias("low")), "contract_id").where(
        F.exists("words", lambda w: F.contains(F.col("low"), w)))
    return hit.groupBy("contract_id", "name").agg(F.array_sort(F.collect_set("clause_type")).alias("source_clause_types"))


def judged_transitions(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: unknown end, forbidden move, self loop, terminal source."""
    ends = states.select("machine", "name", "category", "is_terminal")
    src = ends.select("machine", F.col("name").alias("source"), F.col("category").alias("s_cat"), F.col("is_terminal").alias("s_term"))
    dst = ends.select("machine", F.col("name").alias("target"), F.col("category").alias("t_cat"))
    both = transitions.join(src, ["machine", "source"], "left").join(dst, ["machine", "target"], "left")
    forbidden = F.lit(False)
    for a, b in lookups.FORBIDDEN_CATEGORY_MOVES:
        forbidden = forbidden | ((F.col("s_cat") == a) & (F.col("t_cat") == b))
    reason = (F.when(F.col("s_cat").isNull() | F.col("t_cat").isNull(), "unknown_state")
              .when(forbidden, "forbidden_move").when(F.col("source") == F.col("target"), "self_loop")
              .when(F.col("s_term"), "terminal_source"))
    return both.withColumn("reject_reason", reason).drop("s_cat", "t_cat", "s_term")


def accepted_transitions(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """Valid transitions; machines left without any get the default flow under the same rules."""
    columns = ["machine", "source", "target", "trigger", "confidence"]
    good = judged_transitions(transitions, states).where("reject_reason IS NULL").select(*columns)
    bare = states.select("machine").distinct().join(good.select("machine").distinct(), "machine", "left_anti")
    flow = states.sparkSession.createDataFrame(lookups.DEFAULT_TRANSITIONS, "source string, target string")
    default = (
        bare.join(states.select("machine", F.col("name").alias("source")), "machine")
        .join(F.broadcast(flow), "source")
        .withColumn("trigger", F.concat(F.upper("source"), F.lit("_TO_"), F.upper("target")))
        .withColumn("confidence", F.lit(0.6)))
    fallback = judged_transitions(default.select(*columns), states).where("reject_reason IS NULL").select(*columns)
    return good.unionByName(fallback)


def initial_states(states: DataFrame) -> DataFrame:
    """draft > signed > effective > active, else the first state."""
    rank = F.lit(len(lookups.INITIAL_CANDIDATES))
    for i, name in reversed(list(enumerate(lookups.INITIAL_CANDIDATES))):
        rank = F.when(F.col("name") == name, F.lit(i)).otherwise(rank)
    return states.groupBy("machine").agg(F.min_by("name", F.struct(rank.alias("r"), F.col("ord").alias("o"))).alias("initial"))


# --- observed events --------------------------------------------------------------------

def observed_steps(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """key, previous, event, ts, event_id for consecutive events of a key, in order of ts and event_id.

    Events are stored once in ranges of (key, ts, event_id) that hold about as many rows
    each, so neither a key with very many events nor one busy hour or instant of it fills
    a task. Steps are found inside (key, range), and the last event of a range meets the
    first of the key's next one; only one row per range meets in the window over a whole
    key. ``ranges`` sets their number (else the shuffle partitions).
    """
    place = ["key", "ts", "event_id"]
    narrow = events.select("key", "event", "ts", "event_id")
    dealt = narrow.repartitionByRange(ranges, *place) if ranges else narrow.repartitionByRange(*place)
    cut = stored(dealt.withColumn("_b", F.spark_partition_id()), "steps")
    inside = Window.partitionBy("key", "_b").orderBy("ts", "event_id")
    near = cut.withColumn("previous", F.lag("event").over(inside)).where("previous IS NOT NULL").select(
        "key", "previous", "event", "ts", "event_id")
    order = F.struct("ts", "event_id")
    ends = cut.groupBy("key", "_b").agg(
        F.min_by("event", order).alias("event"), F.min(order).alias("at"), F.max_by("event", order).alias("last"))
    across = ends.withColumn("previous", F.lag("last").over(Window.partitionBy("key").orderBy("_b"))).where(
        "previous IS NOT NULL").select("key", "previous", "event", F.col("at.ts").alias("ts"), F.col("at.event_id").alias("event_id"))
    return near.unionByName(across)


def machines_from_events(events: DataFrame, describe: Column) -> tuple[DataFrame, DataFrame]:
    """States in order of first appearance and the distinct observed transitions of every key."""
    firsts = events.groupBy(F.col("key").alias("machine"), F.col("event").alias("name")).agg(
        F.min(F.struct("ts", "event_id")).alias("at"), F.count("*").alias("n"))
    # A machine has one row per state here, so its window is as small as its state set.
    ranked = firsts.withColumn("ord", F.row_number().over(Window.partitionBy("machine").orderBy("at")))
    states = normalized_states(ranked.select(
        "machine", "ord", "name", describe.alias("description"),
        F.round(F.col("n") / (F.col("n") + 10), 6).alias("confidence"), F.lit(False).alias("is_terminal")))
    steps = observed_steps(events).groupBy(F.col("key").alias("machine"), F.col("previous").alias("source"), F.col("event").alias("target")).agg(
        F.count("*").alias("n"))
    transitions = steps.select("machine", "source", "target", F.concat(F.lit("AFTER_"), F.upper("source")).alias("trigger"),
                               F.round(F.col("n") / (F.col("n") + 10), 6).alias("confidence"))
    return states, transitions


def conformance(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Steps and violations per (previous, event) against an allowed-transition table (source, target)."""
    steps = observed_steps(events).groupBy("previous", "event").agg(F.count("*").alias("n_steps"))
    ok = allowed.select(F.col("source").alias("previous"), F.col("target").alias("event"), F.lit(True).alias("ok"))
    return steps.join(ok, ["previous", "event"], "left").select(
        "previous", "event", "n_steps", F.coalesce("ok", F.lit(False)).alias("is_allowed"))


# --- validation -------------------------------------------------------------------------

def reachable(transitions: DataFrame, initial: DataFrame, growth: float = 4.0) -> DataFrame:
    """machine, name, depth (fewest moves) for every state reachable from the initial one, all machines at once.

    Shortcuts of ``hop`` moves start as the transitions and are squared after a round, so
    a chain of n states settles in about log2(n) rounds. With all states nearer than
    ``near`` moves known, the last ``hop`` depths joined with the shortcuts give exactly
    those of depth ``near`` to ``near + hop - 1``; a round that finds none is the last.
    Shortcuts into known states are dropped, as no later round needs them. Shortcuts whose
    square could have more than ``growth`` rows per transition (dense machines, which are
    not deep) stay as they are. A round writes its new states only. Moves with a null end
    lead nowhere.
    """
    spark = transitions.sparkSession
    hops = cut_lineage(transitions.select("machine", F.col("source").alias("name"), F.col("target").alias("next")).where(
        "machine IS NOT NULL AND name IS NOT NULL AND next IS NOT NULL AND name <> next").distinct())
    limit = growth * hops.count()
    start = initial.select("machine", F.col("initial").alias("name"), F.lit(0).cast("long").alias("depth"))
    folder = scratch_path(spark, "reachable")
    start.write.parquet(f"{folder}/near=0")
    seen_so_far = lambda: spark.read.schema(start.schema).parquet(folder).select("machine", "name", "depth")
    near, hop, squarable = 1, 1, True
    while True:
        seen = seen_so_far()
        fresh = seen.where(F.col("depth") >= near - hop).join(hops, ["machine", "name"]).groupBy(
            "machine", F.col("next").alias("name")).agg((F.min("depth") + hop).alias("depth"))
        path = f"{folder}/near={near}"
        fresh.join(seen, ["machine", "name"], "left_anti").write.parquet(path)
        if spark.read.schema(start.schema).parquet(path).isEmpty():
            return seen
        near += hop
        if squarable:
            ways_in = hops.groupBy("machine", F.col("next").alias("name")).agg(F.count("*").alias("n_in"))
            ways_out = hops.groupBy("machine", "name").agg(F.count("*").alias("n_out"))
            squared = ways_in.join(ways_out, ["machine", "name"]).agg(F.sum(F.col("n_in") * F.col("n_out"))).first()[0] or 0
            squarable = squared <= limit
        if squarable:
            first = hops.withColumnRenamed("next", "middle")
            second = hops.select("machine", F.col("name").alias("middle"), "next")
            known = seen_so_far().select("machine", F.col("name").alias("next"))
            hops = cut_lineage(first.join(second, ["machine", "middle"]).select("machine", "name", "next").distinct().join(
                known, ["machine", "next"], "left_anti").select("machine", "name", "next"))
            hop *= 2


def non_deterministic(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("machine", "source", "trigger").agg(
        F.count_distinct("target").alias("n_targets")).where("n_targets > 1")


def structure_gate(states: DataFrame, transitions: DataFrame, required: list[str] | None = None,
                   minimum: int = lookups.MINIMUM_TRANSITIONS) -> DataFrame:
    """Per machine of ``states``: missing required states in their order, transitions, and whether both gates pass.

    Repeated states or transitions count once; a transition differs by source, target or trigger.
    """
    required = lookups.REQUIRED_STATES if required is None else required
    has = [F.max(F.col("name").eqNullSafe(name)).alias(f"has_{i}") for i, name in enumerate(required)]
    present = states.groupBy("machine").agg(F.count("*").alias("n_states"), *has)
    missing = F.filter(F.array(*[F.when(~F.col(f"has_{i}"), name) for i, name in enumerate(required)]).cast("array<string>"),
                       lambda x: x.isNotNull())
    moves = transitions.select("machine", "source", "target", "trigger").distinct().groupBy("machine").agg(
        F.count("*").alias("n_transitions"))
    joined = present.join(moves.withColumnRenamed("machine", "m"), F.col("machine").eqNullSafe(F.col("m")), "left")
    n = F.coalesce("n_transitions", F.lit(0))
    return joined.select("machine", missing.alias("missing_states"), n.alias("n_transitions")).withColumn(
        "passes", (F.size("missing_states") == 0) & (F.col("n_transitions") >= minimum))


def orphan_states(states: DataFrame, transitions: DataFrame) -> DataFrame:
    ends = transitions.select("machine", F.explode(F.array("source", "target")).alias("name")).distinct()
    return states.select("machine", "name").join(ends, ["machine", "name"], "left_anti")


def terminal_with_exit(states: DataFrame, transitions: DataFrame) -> DataFrame:
    ends = states.where("is_terminal").select("machine", F.col("name").alias("source"))
    return transitions.join(ends, ["machine", "source"], "left_semi").select("machine", "source", "target")


def validation_summary(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """Per machine: reachability, determinism, warnings; ``passes_gate`` applies the configured limits."""
    reach = reachable(transitions, initial_states(states)).join(
        states.select("machine", "name"), ["machine", "name"], "left_semi").groupBy("machine").agg(F.count("*").alias("n_reachable"))
    # Rounded before the gate, which reads the figure that is shown; on the double and not on its
    # decimal digits, as SQL engines do, for means of few six-digit figures often end in a half.
    mean = F.floor(F.avg("confidence") * 1e6 + 0.5) / 1e6
    size = states.groupBy("machine").agg(F.count("*").alias("n_states"), mean.alias("avg_confidence"))
    part = lambda df, name: df.groupBy("machine").agg(F.count("*").alias(name))
    out = size.join(reach, "machine", "left")
    for frame, name in [(non_deterministic(transitions), "n_non_deterministic"), (orphan_states(states, transitions), "n_orphans"),
                        (terminal_with_exit(states, transitions), "n_terminal_exits"), (transitions, "n_transitions")]:
        out = out.join(part(frame, name), "machine", "left")
    out = out.na.fill(0)
    warnings = ((F.col("n_reachable") < F.col("n_states")).cast("int") + (F.col("n_non_deterministic") > 0).cast("int")
                + (F.col("n_orphans") > 0).cast("int") + F.col("n_terminal_exits"))
    gate = lookups.QUALITY_GATE
    share = F.col("n_reachable") / F.col("n_states")
    return out.withColumn("n_warnings", warnings).select(
        "machine", "n_states", "n_transitions", F.round(share * 100, 6).alias("reachability_percentage"),
        (F.col("n_non_deterministic") == 0).alias("is_deterministic"), "n_orphans", "n_terminal_exits", "n_warnings",
        F.lit(True).alias("is_valid"), "avg_confidence",
        ((share >= gate["minimum_reachability"]) & (F.col("n_warnings") <= gate["maximum_warnings"])
         & (F.col("avg_confidence") >= gate["minimum_confidence"])).alias("passes_gate"))


# --- machine records --------------------------------------------------------------------

CONFIG_SCHEMA = "id string, initial string, states map<string, struct<type: string, on: map<string, string>>>"


def machine_records(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """One JSON config per machine (a machine holds as many entries as it has states)."""
    outs = transitions.groupBy("machine", F.col("source").alias("name")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", "trigger", "target").alias("k"), F.col("target").alias("v"))))).alias("on"))
    entry = F.struct(F.when(F.col("is_terminal"), "final").alias("type"), F.col("on"))
    body = states.join(outs, ["machine", "name"], "left").groupBy("machine").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), entry.alias("e"))), lambda a, b: F.when(
            a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).alias("states"))
    return body.join(initial_states(states), "machine").select(
        "machine", F.to_json(F.struct(F.concat(F.lit("machine-"), "machine").alias("id"), "initial", "states")).alias("config"))


def parse_configs(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``records``: machine, config.  (heads, states, transitions); a target is a string or {target}."""
    parsed = records.select("machine", F.from_json("config", CONFIG_SCHEMA).alias("c"))
    heads = parsed.select("machine", F.col("c.id").alias("id"), F.col("c.initial").alias("initial"),
                          F.col("c.states").isNotNull().alias("has_states"))
    states = parsed.select("machine", F.explode("c.states").alias("name", "s"))
    target = F.when(F.col("t").startswith("{"), F.get_json_object("t", "$.target")).otherwise(F.col("t"))
    transitions = states.select("machine", F.col("name").alias("source"), F.explode("s.on").alias("trigger", "t")).select(
        "machine", "source", "trigger", target.alias("target"))
    return heads, states.select("machine", "name", F.coalesce(F.col("s.type") == "final", F.lit(False)).alias("is_terminal")), transitions


def config_messages(heads: DataFrame, states: DataFrame, transitions: DataFrame) -> DataFrame:
    """machine, severity, code, item for every finding about a config."""
    row = lambda df, severity, code, item: df.select("machine", F.lit(severity).alias("severity"), F.lit(code).alias("code"), item.alias("item"))
    names = states.select("machine", "name")
    missing = F.filter(F.array(F.when(F.col("id").isNull(), F.lit("id")), F.when(F.col("initial").isNull(), F.lit("initial")),
                               F.when(~F.col("has_states"), F.lit("states"))), lambda x: x.isNotNull())
    initial = heads.where("initial IS NOT NULL").select("machine", "initial")
    reach = reachable(transitions.where("target IS NOT NULL"), initial)
    exits = transitions.select("machine", F.col("source").alias("name")).distinct()
    return (
        row(heads.select("machine", F.explode(missing).alias("m")), "error", "missing_field", F.col("m"))
        .unionByName(row(initial.where("initial <> ''").join(names.withColumnRenamed("name", "initial"), ["machine", "initial"], "left_anti"),
                         "error", "unknown_initial", F.col("initial")))
        .unionByName(row(transitions.join(names.withColumnRenamed("name", "target"), ["machine", "target"], "left_anti"),
                         "error", "unknown_target", F.concat_ws(">", "source", "target")))
        .unionByName(row(names.join(initial.select("machine"), "machine", "left_semi").join(
            reach.select("machine", "name"), ["machine", "name"], "left_anti"), "warning", "unreachable", F.col("name")))
        .unionByName(row(states.where("NOT is_terminal").join(exits, ["machine", "name"], "left_anti"),
                         "suggestion", "no_exit", F.col("name"))))


def machine_profile(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """State kinds, transitions, events, mean per state, complexity score and level."""
    s = states.groupBy("machine").agg(F.count("*").alias("total_states"), F.count_if("is_terminal").alias("final_states"))
    t = transitions.groupBy("machine").agg(F.count("*").alias("total_transitions"), F.count_distinct("trigger").alias("unique_events"))
    score = F.col("total_states") + F.col("total_transitions")
    level = F.when(score < 5, "simple").when(score < 15, "moderate").when(score < 30, "complex").otherwise("very_complex")
    per_state = F.round(F.col("total_transitions") / F.greatest("total_states", F.lit(1)), 6)
    return s.join(t, "machine", "left").na.fill(0).select(
        "machine", "total_states", "final_states", (F.col("total_states") - F.col("final_states")).alias("simple_states"),
        "total_transitions", "unique_events", score.alias("complexity_score"), level.alias("complexity_level"),
        per_state.alias("branching_factor"))


def lifecycle_stats(states: DataFrame, transitions: DataFrame, summary: DataFrame) -> DataFrame:
    s = states.agg(F.count("*").alias("total_states"), F.avg("confidence").alias("average_confidence"),
                   F.count_if(F.col("confidence") > 0.8).alias("high_confidence_states"),
                   *[F.count_if(F.col("category") == c).alias(c) for c, _ in lookups.CATEGORY_STEMS])
    t = transitions.agg(F.count("*").alias("total_transitions"))
    v = summary.agg(F.count("*").alias("total_machines"), F.avg(F.col("is_valid").cast("int")).alias("valid_rate"),
                    F.avg((F.col("n_warnings") > 0).cast("int")).alias("warning_rate"),
                    F.avg("reachability_percentage").alias("mean_reachability"))
    n = F.greatest("total_machines", F.lit(1))
    return s.crossJoin(t).crossJoin(v).select(
        "*", (F.col("total_states") / n).alias("states_per_machine"), (F.col("total_transitions") / n).alias("transitions_per_machine"))


def confidence_band(confidence: Column, bands=None, below: str = "very_low") -> Column:
    expr = None
    for name, cut in bands or lookups.CONFIDENCE_BANDS:
        expr = F.when(confidence >= cut, name) if expr is None else expr.when(confidence >= cut, name)
    return expr.otherwise(below)


def quality_score(state: Column, transition: Column, validation: Column, business: Column) -> Column:
    w = lookups.QUALITY_WEIGHTS
    return (state * w["state_confidence"] + transition * w["transition_confidence"] + validation * w["fsm_validation"]
            + business * w["business_logic"])


# --- contract text ----------------------------------------------------------------------

def contract_context(clauses: DataFrame, length: int = CONTEXT_LENGTH) -> DataFrame:
    """The text of a contract's clauses in windows for prompts, and a key over all of them.

    Parts come in order of type and clause; a part longer than a window is cut into
    pieces. A window holds the pieces whose last character falls in its ``length``
    characters, so windows cover everything and none has twice the length. Running
    lengths go over ranges of clauses first, then inside a range, so a contract with
    very many clauses is no single task. The key covers every clause through a count
    and a sum of part hashes (each with its place), which merge without bringing the
    texts together.
    """
    rank = F.lit(len(lookups.CONTEXT_FIRST_TYPES))
    for i, name in reversed(list(enumerate(lookups.CONTEXT_FIRST_TYPES))):
        rank = F.when(F.col("clause_type") == name, F.lit(i)).otherwise(rank)
    parts = clauses.where(strip(F.col("text")) != "").select(
        "contract_id", "clause_seq", rank.alias("rank"), F.concat(F.lit("["), "clause_type", F.lit("] "), "text").alias("part"))
    place = F.concat_ws(":", F.col("rank").cast("string"), F.col("clause_seq").cast("string"), "part")
    hashed = F.conv(F.substring(F.sha2(place, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    keys = parts.groupBy("contract_id").agg(F.count("*").alias("n_parts"), F.sum(hashed).alias("h"))
    group = ["contract_id", "rank", "range"]
    sized = parts.withColumn("range", F.floor(F.col("clause_seq") / CONTEXT_RANGE)).withColumn("n", F.length("part"))
    earlier = Window.partitionBy("contract_id").orderBy("rank", "range").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy(*group).agg(F.sum("n").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy(*group).orderBy("clause_seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, group)
    starts = F.sequence(F.lit(0), F.ceil(F.col("n") / length).cast("int") - 1)
    pieces = placed.select(
        "contract_id", "rank", "clause_seq", (F.col("before") + F.col("at")).alias("at"), "part", F.explode(starts).alias("k"))
    pieces = pieces.withColumn("piece", F.substring("part", F.col("k") * length + 1, F.lit(length))).withColumn(
        "window_no", F.floor((F.col("at") + F.col("k") * length + F.length("piece") - 1) / length).cast("long"))
    windows = pieces.groupBy("contract_id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("rank", "clause_seq", "k", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n")
    key = F.concat(F.lit("lifecycle_"), F.substring(F.sha2(F.concat_ws("|", "n_parts", F.col("h").cast("string")), 256), 1, 16))
    return keys.join(windows, "contract_id").select("contract_id", "n_parts", "window_no", text.alias("context"), key.alias("cache_key"))


# --- model answers ----------------------------------------------------------------------

STATE_FIELDS = "array<struct<name: string, description: string, confidence: double, evidence: string, is_terminal: boolean>>"
# Keyword fallback states, and defaults of rebuilt states.
FALLBACK_STATES = [
    ("draft", "Contract is in draft form"), ("under_review", "Contract is being reviewed"),
    ("approved", "Contract has been approved"), ("signed", "Contract has been signed"),
    ("effective", "Contract is effective"), ("active", "Contract is actively operating"),
    ("terminated", "Contract has been terminated"),
]
MANUAL_PATTERNS = [
    (r'(?is)"name"\s*:\s*"([^"]+)".*?"description"\s*:\s*"([^"]+)".*?"confidence"\s*:\s*([0-9.]+)', 3),
    (r"(?is)name[:\s]*([A-Za-z_]+).*?description[:\s]*([^,}\n]+).*?confidence[:\s]*([0-9.]+)", 3),
    (r"(?is)([a-z_]+)\s*state.*?confidence[:\s]*([0-9.]+)", 2),
]
_STRICT = {"allowSingleQuotes": "false"}


def basic_clean(response: Column) -> Column:
    """Fence marks off, outermost braces only, no trailing commas, property names quoted."""
    out = F.regexp_replace(F.regexp_replace(response, r"(?im)^```json\s*", ""), r"(?m)\s*```\s*$", "")
    inner = F.regexp_substr(out, F.lit(r"(?s)\{.*\}"))
    out = F.regexp_replace(F.coalesce(inner, out), r",(\s*[}\]])", "$1")
    return strip(F.regexp_replace(out, r"(\w+)(\s*:)", '"$1"$2'))


def aggressive_clean(response: Column) -> Column:
    """Also single-quoted text, stray backslashes and characters outside printable ASCII."""
    out = F.regexp_replace(basic_clean(response), r'\\(?!["\\/bfnrt])', r"\\\\\\\\")
    return F.regexp_replace(F.regexp_replace(out, r"'([^']*)'(\s*[:,}])", '"$1"$2'), r"[^\x20-\x7E]", "")


def _usable(states: Column) -> Column:
    return F.coalesce((F.size(states) > 0) & F.forall(states, lambda s: s["name"].isNotNull()), F.lit(False))


def _state(name, description, confidence, evidence, terminal) -> Column:
    return F.struct(name.alias("name"), description.alias("description"), confidence.alias("confidence"),
                    evidence.alias("evidence"), terminal.alias("is_terminal"))


def parsed_states(response: Column) -> tuple[Column, Column]:
    """(states, parse_stage) of a model answer: clean, aggressive, rebuild, manual, fallback, empty."""
    read = lambda text: F.from_json(text, f"struct<states: {STATE_FIELDS}>", _STRICT)["states"]
    value = lambda obj, key: F.nullif(F.regexp_extract(obj, rf'"{key}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    number = lambda obj: F.nullif(F.regexp_extract(obj, r'"confidence"\s*:\s*([0-9.]+)', 1).try_cast("double"), F.lit(0.0))
    objects = F.regexp_extract_all(response, F.lit(r'\{[^{}]*"name"[^{}]*\}'), 0)
    rebuilt = F.filter(F.transform(objects, lambda o: _state(
        value(o, "name"), F.coalesce(value(o, "description"), F.lit("Contract state")), F.coalesce(number(o), F.lit(0.7)),
        F.coalesce(value(o, "evidence"), F.lit("Extracted from contract analysis")),
        F.regexp_extract(o, r'"is_terminal"\s*:\s*(true|false)', 1) == "true")), lambda s: s["name"].isNotNull())
    manual = []
    for pattern, groups in MANUAL_PATTERNS:
        names = F.regexp_extract_all(response, F.lit(pattern), 1)
        texts = F.regexp_extract_all(response, F.lit(pattern), 2) if groups == 3 else F.transform(names, lambda n: F.concat(n, F.lit(" state")))
        numbers = F.regexp_extract_all(response, F.lit(pattern), groups)
        rows = F.transform(F.arrays_zip(names.alias("n"), texts.alias("t"), numbers.alias("c")), lambda z: _state(
            F.regexp_replace(F.lower(z["n"]), "[^a-z_]", ""), F.regexp_replace(strip(z["t"]), "^[\"']+|[\"']+$", ""),
            F.least(F.coalesce(z["c"].try_cast("double"), F.lit(0.7)), F.lit(1.0)), F.lit("Extracted from LLM response"),
            F.lower(z["n"]).rlike("terminated|expired")))
        manual.append(F.filter(rows, lambda s: s["name"] != ""))
    low = F.lower(response)
    guesses = F.filter(F.array(*[F.when(
        low.rlike("|".join([name.replace("_", " "), name, *name.split("_")])),
        _state(F.lit(name), F.lit(text), F.lit(0.5), F.lit("Generated from fallback analysis"), F.lit(name == "terminated")))
        for name, text in FALLBACK_STATES]), lambda s: s.isNotNull())
    default = F.array(_state(F.lit("active"), F.lit("Contract is in active state"), F.lit(0.5), F.lit("Default fallback state"), F.lit(False)))
    fallback = F.when(F.size(guesses) > 0, guesses).otherwise(default)
    empty = F.coalesce(strip(response), F.lit("")) == ""
    first, second = read(basic_clean(response)), read(aggressive_clean(response))
    has_key = F.contains(response, F.lit('"states"'))
    hand = F.coalesce(*[F.when(F.size(m) > 0, m) for m in manual])
    stage = (F.when(empty, "empty").when(_usable(first), "clean").when(_usable(second), "aggressive")
             .when(has_key & (F.size(rebuilt) > 0), "rebuild").when(hand.isNotNull(), "manual").otherwise("fallback"))
    states = (F.when(empty, F.array().cast(STATE_FIELDS)).when(_usable(first), first).when(_usable(second), second)
              .when(has_key & (F.size(rebuilt) > 0), rebuilt).when(hand.isNotNull(), hand).otherwise(fallback))
    return states, stage


def parsed_transitions(response: Column) -> Column:
    """array<struct<source, target>> from JSON, rebuilt objects or "a -> b" wording."""
    fields = "struct<transitions: array<struct<source_state: string, target_state: string>>>"
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    clean = F.transform(F.from_json(basic_clean(response), fields, _STRICT)["transitions"], lambda t: pair(t["source_state"], t["target_state"]))
    objects = F.regexp_extract_all(response, F.lit(r'\{[^{}]*"source_state"[^{}]*\}'), 0)
    value = lambda o, k: F.nullif(F.regexp_extract(o, rf'"{k}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    rebuilt = F.transform(objects, lambda o: pair(value(o, "source_state"), value(o, "target_state")))
    arrows = r"(?i)([a-z_]+)\s*(?:->|to|transitions?\s+to)\s*([a-z_]+)"
    named = F.transform(F.arrays_zip(F.regexp_extract_all(response, F.lit(arrows), 1).alias("a"), F.regexp_extract_all(response, F.lit(arrows), 2).alias("b")),
                        lambda z: pair(F.lower(z["a"]), F.lower(z["b"])))
    good = lambda ts: F.filter(ts, lambda t: t["source"].isNotNull() & t["target"].isNotNull())
    tries = [good(clean), good(rebuilt), F.filter(good(named), lambda t: t["source"] != t["target"])]
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries])
