"""Scene-graph operators over ``nodes(scene, id, class_name, category, states, properties, ...)`` and
``edges(scene, from_id, relation, to_id)``."""

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.draws import uniform
from tidewright.operators.relational import latest
from tidewright.operators.scan import chunk_of, scan
from tidewright.session import durable


def unique_graph(nodes: DataFrame, edges: DataFrame, order: str, scene="scene"):
    """Last node per id and last edge per (from, relation, to)."""
    return latest(nodes, [scene, "id"], order), latest(edges, [scene, "from_id", "relation", "to_id"], order)


def is_room(name=None) -> Column:
    room = F.col("category") == "Rooms"
    return room if name is None else room & (F.col("class_name") == name)


def attr_is(attr: str, value) -> Column:
    return F.col(attr) == value


def attr_has(attr: str, value) -> Column:
    return F.array_contains(attr, value)


def with_relation(nodes: DataFrame, edges: DataFrame, relation: str, targets: DataFrame, at_least=1, scene="scene") -> DataFrame:
    """Nodes with at least ``at_least`` edges of a relation into the targets."""
    hits = edges.where(F.col("relation") == relation).join(
        targets.select(scene, F.col("id").alias("to_id")).distinct(), [scene, "to_id"], "left_semi"
    )
    if at_least == 1:
        sources = hits.select(scene, F.col("from_id").alias("id"))
    else:
        counts = hits.groupBy(scene, F.col("from_id").alias("id")).agg(F.count("*").alias("_n"))
        sources = counts.where(F.col("_n") >= at_least)
    return nodes.join(sources, [scene, "id"], "left_semi")


def with_relations(nodes: DataFrame, edges: DataFrame, pairs, scene="scene") -> DataFrame:
    """Nodes that meet every ``(relation, targets)`` pair."""
    for relation, targets in pairs:
        nodes = with_relation(nodes, edges, relation, targets, 1, scene)
    return nodes


def room_ids(nodes: DataFrame, name: str) -> DataFrame:
    """Lowest id of the room with a name, per scene."""
    return nodes.where(is_room(name)).groupBy("scene").agg(F.min("id").alias("room_id"))


AXES = ("x", "y", "z")


def _cell(size) -> dict:
    return {f"c{a}": F.floor(F.col(a) / F.lit(size)).cast("bigint") for a in AXES}


def _gap(cell, size, far: bool):
    """Squared distance of the point (px, py, pz) from the nearest or farthest corner of a cell."""
    total = F.lit(0.0)
    for a in AXES:
        low, high = cell(f"c{a}") * F.lit(size) - F.col(f"p{a}"), F.col(f"p{a}") - (cell(f"c{a}") + 1) * F.lit(size)
        d = F.greatest(F.abs(low), F.abs(high)) if far else F.greatest(F.lit(0.0), low, high)
        total = total + d * d
    return total


CROWD = 32  # objects that share the cell of an object, on average, at most
FINEST = 12  # halvings of a cell at most
FEW_KEYS = 10_000  # key sets whose cell widths are broadcast


def _widths(placed: DataFrame, keys, cell: float) -> DataFrame:
    """``(keys..., _w)``: ``cell`` halved until an object shares its cell with few others, per key set."""
    spread = placed.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(FINEST)))).withColumn("_w", F.lit(float(cell)) / F.pow(F.lit(2.0), F.col("_l")))
    held = spread.groupBy(*keys, "_w", *[c.alias(n) for n, c in _cell(F.col("_w")).items()]).agg(F.count("*").alias("_c"))
    crowds = held.groupBy(*keys, "_w").agg((F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).alias("_crowd"))
    wide = F.max(F.when(F.col("_crowd") <= CROWD, F.col("_w")))
    widths = durable(crowds.groupBy(*keys).agg(F.coalesce(wide, F.min("_w")).alias("_w")))
    return F.broadcast(widths) if widths.count() <= FEW_KEYS else widths


def nearest(points: DataFrame, objects: DataFrame, keys, point_id: str, cell: float) -> DataFrame:
    """Nearest object of the same keys for each point, -1 when there is none. The lowest id wins among equals.

    Objects of one place stand as their lowest id and equal points are asked once. ``cell`` is halved, per key set, until its
    cells hold few objects. First a point meets the objects of its own and the 26 neighbouring cells by an equi-join; an answer
    within one cell's width is final. The few points that stay open descend a summary of the occupied cells, each level half as wide as the one
    before: of the cells below those that are left, the one with the nearest farthest corner bounds the answer and drops
    the others that begin beyond it. No task or row holds all cells of a class.
    """
    keys = list(keys)
    coords, spot = [f"c{a}" for a in AXES], [*keys, *[f"p{a}" for a in AXES]]
    whole = F.col("_w")
    placed = durable(objects.groupBy(*keys, *AXES).agg(F.min(F.struct("id"))["id"].alias("id")))
    widths = _widths(placed, keys, cell)
    placed = placed.join(widths, keys).withColumns(_cell(whole))
    named = points.select(*keys, point_id, *[F.col(a).cast("double").alias(f"p{a}") for a in AXES])
    asked = named.select(*spot).distinct().join(widths, keys).withColumns({f"c{a}": F.floor(F.col(f"p{a}") / whole).cast("bigint") for a in AXES})
    squared = sum(((F.col(f"p{a}") - F.col(a)) * (F.col(f"p{a}") - F.col(a)) for a in AXES), F.lit(0.0))

    def met(probes):
        hits = probes.join(placed.drop("_w"), [*keys, *coords])
        return hits.groupBy(*spot, "_w").agg(F.min(F.struct(squared.alias("d"), F.col("id"))).alias("_b"))

    around = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, step)]) for step in itertools.product((-1, 0, 1), repeat=3)])
    ring = asked.withColumn("_d", F.explode(around)).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"_d.d{a}") for a in AXES}).drop("_d")
    first = durable(met(ring))
    # every object nearer than the rim of the 27 cells was met
    open_points = durable(asked.drop(*coords).join(first.where(F.col("_b.d") <= whole * whole).select(*spot), spot, "left_anti"))
    found = first
    if not open_points.isEmpty():
        cells = durable(placed.select(*keys, "_w", *coords).distinct())
        spans = cells.agg(*[F.max(F.greatest(F.abs(F.col(c)), F.abs(F.col(c) + 1))).alias(c) for c in coords]).first()
        top = max(1, max(s or 0 for s in spans).bit_length())  # at this level every cell lies in one of the eight around the origin
        at_level = lambda level: {f"c{a}": F.floor(F.col(f"c{a}") / F.lit(float(1 << level))).cast("bigint") for a in AXES}
        left = open_points.join(cells.select(*keys, *[c.alias(n) for n, c in at_level(top).items()]).distinct(), keys)
        for level in range(top, -1, -1):
            if level < top:
                below = cells.select(*keys, *[c.alias(n) for n, c in at_level(level).items()]).distinct()
                below = below.withColumns({f"u{a}": F.floor(F.col(f"c{a}") / 2).cast("bigint") for a in AXES})
                left = left.withColumnsRenamed({f"c{a}": f"u{a}" for a in AXES}).join(below, [*keys, *[f"u{a}" for a in AXES]]).drop(*[f"u{a}" for a in AXES])
            width = whole * F.lit(float(1 << level))
            bound = F.min(_gap(F.col, width, True)).over(Window.partitionBy(*spot))
            left = left.withColumn("_bound", bound).where(_gap(F.col, width, False) <= F.col("_bound") * (1 + 1e-12) + 1e-12).drop("_bound")
            if level % 4 == 0:
                left = durable(left)  # the plan stays short
        found = first.unionByName(met(left)).groupBy(*spot).agg(F.min("_b").alias("_b"))
    told = named.join(found.select(*spot, "_b"), spot).groupBy(*keys, point_id).agg(F.min("_b").alias("_b"))
    best = told.select(*keys, point_id, F.col("_b.id").alias("nearest_id"), F.sqrt("_b.d").alias("distance"))
    return points.select(*keys, point_id).join(best, [*keys, point_id], "left").withColumn(
        "nearest_id", F.coalesce("nearest_id", F.lit(-1).cast("bigint"))
    )


def sub_graph(nodes: DataFrame, edges: DataFrame, classes: DataFrame, names: DataFrame, properties: DataFrame, scene="scene"):
    """``(nodes, edges, dropped)``: nodes of listed classes, edges with both ends kept, renamed and described.

    ``classes(class_name)``, ``names(class_name, script_name)`` and ``properties(class_name, properties)``
    are look-up tables; Spark broadcasts them when their size allows.
    """
    kept = nodes.join(classes.select("class_name").distinct(), "class_name", "left_semi")
    dropped = nodes.join(classes.select("class_name").distinct(), "class_name", "left_anti")
    ids = kept.select(scene, "id")
    inner = edges.join(ids.withColumnRenamed("id", "from_id"), [scene, "from_id"], "left_semi")
    inner = inner.join(ids.withColumnRenamed("id", "to_id"), [scene, "to_id"], "left_semi").select(*edges.columns)
    renamed = kept.join(names, "class_name", "left")
    script = F.lower(F.regexp_replace(F.coalesce("script_name", "class_name"), " ", "_"))
    renamed = renamed.withColumn("class_name", script).drop("script_name")
    known = properties.select("class_name", F.col("properties").alias("_p"))
    described = renamed.join(known, "class_name", "left").withColumn("properties", F.coalesce("_p", "properties")).drop("_p")
    return described.select(*nodes.columns), inner, dropped.select(*nodes.columns)


def visible(nodes: DataFrame, edges: DataFrame, agents: DataFrame) -> DataFrame:
    """``(scene, agent, id)`` of what each agent sees.

    An agent sees everything inside its room at any depth unless its direct container is closed,
    every room, and what it holds. Containment is followed one level per round; each round is
    written to the checkpoint folder.
    """
    inside = edges.where("relation = 'INSIDE'").select("scene", F.col("from_id").alias("id"), F.col("to_id").alias("parent"))
    at = agents.join(inside.withColumnRenamed("id", "agent"), ["scene", "agent"]).withColumnRenamed("parent", "room")
    frontier = at.select("scene", "room").distinct().join(inside.withColumnRenamed("parent", "room"), ["scene", "room"])
    frontier = durable(frontier.select("scene", "room", "id"))
    found = frontier
    while True:  # a cycle ends too: only nodes not found before go on
        step = frontier.withColumnRenamed("id", "parent").join(inside, ["scene", "parent"]).select("scene", "room", "id")
        frontier = durable(step.join(found, ["scene", "room", "id"], "left_anti").distinct())
        if frontier.isEmpty():
            break
        found = durable(found.unionByName(frontier))
    holders = nodes.select("scene", F.col("id").alias("parent"), (is_room() | attr_has("states", "OPEN")).alias("_open"))
    open_parent = inside.join(holders.where("_open"), ["scene", "parent"], "left_semi").select("scene", "id")
    seen = found.join(open_parent, ["scene", "id"], "left_semi")
    by_room = at.select("scene", "agent", "room").join(seen, ["scene", "room"]).select("scene", "agent", "id")
    rooms = agents.join(nodes.where(is_room()).select("scene", "id"), "scene").select("scene", "agent", "id")
    held = edges.where("relation LIKE 'HOLDS%'").select("scene", F.col("from_id").alias("agent"), F.col("to_id").alias("id"))
    held = held.join(agents, ["scene", "agent"], "left_semi")
    return by_room.unionByName(rooms).unionByName(held).distinct()


def visible_edges(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges between nodes that the same agent sees."""
    left = seen.withColumnRenamed("id", "from_id")
    right = seen.withColumnRenamed("id", "to_id")
    return edges.join(left, ["scene", "from_id"]).join(right, ["scene", "agent", "to_id"])


def _divided(held: DataFrame, allowed: DataFrame):
    """Containers with the list of what they need, and the candidates that offer all of a list; equal lists share one division."""
    need = held.select("scene", "container", "object", "relation").distinct().join(
        allowed.select("object", "relation").distinct(), ["object", "relation"], "left_semi"
    )
    wants = F.array_sort(F.collect_list(F.struct("object", "relation"))).alias("wants")
    signed = need.groupBy("scene", "container").agg(wants)
    wanted = signed.select("wants").distinct().select("wants", F.explode("wants").alias("w")).select("wants", "w.*")
    offers = wanted.join(allowed.distinct(), ["object", "relation"]).groupBy("wants", "candidate").agg(F.count("*").alias("_m"))
    return signed, offers.where(F.col("_m") == F.size("wants")).select("wants", "candidate")


def replacement_containers(held: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates allowed for every (object, relation) of a container, other than itself.

    ``held(scene, container, object, relation)``; ``allowed(object, relation, candidate)``.
    """
    signed, fitting = _divided(held, allowed)
    return signed.join(fitting, "wants").where("candidate <> container").select("scene", "container", "candidate")


def replacement_lists(held: DataFrame, allowed: DataFrame):
    """``(needs, offers)``: the sorted list of needs of every (scene, container), and every candidate of every distinct list.

    Both together are ``replacement_containers`` without its pairs: a container takes the candidates of its list, its
    own id left out. They grow with the rows, however many containers share a list.
    """
    return _divided(held, allowed)


def replacement_summary(held: DataFrame, allowed: DataFrame):
    """``(needs, offers)`` as ``replacement_lists``, each container with the number of its ``candidates`` and its ``first_candidate``.

    Both leave out the container itself. A list is counted once, however many containers share it.
    """
    needs, offers = _divided(held, allowed)
    offers = durable(offers)
    totals = offers.groupBy("wants").agg(F.count("candidate").alias("_n"), F.min("candidate").alias("_low"))
    second = offers.join(totals, "wants").where(F.col("candidate") > F.col("_low")).groupBy("wants").agg(F.min("candidate").alias("_next"))
    own = offers.select("wants", F.col("candidate").alias("container"), F.lit(1).alias("_own"))
    rows = needs.join(totals.join(second, "wants", "left"), "wants", "left").join(own, ["wants", "container"], "left")
    named = F.col("container").isNotNull()  # a container without a name differs from no candidate for sure
    others = F.when(named, F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))).otherwise(0).cast("bigint")
    first = F.when(named, F.when(F.col("_low") == F.col("container"), F.col("_next")).otherwise(F.col("_low")))
    return rows.select("scene", "container", "wants", others.alias("candidates"), first.alias("first_candidate")), offers


def replacement_variants(programs: DataFrame, choices: DataFrame, limit: int) -> DataFrame:
    """Program texts with every combination of replacements, at most ``limit`` per program.

    ``choices(program, slot, original, options)``; a combination number is decoded digit by digit,
    so no pairs of options are formed.
    """
    slots = choices.groupBy("program").agg(F.array_sort(F.collect_list(F.struct("slot", "original", "options"))).alias("_s"))
    total = F.aggregate("_s", F.lit(1).cast("bigint"), lambda n, s: F.least(n * F.size(s["options"]), F.lit(limit).cast("bigint")))
    rows = programs.join(slots, "program").withColumn("variant", F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1)))
    start = F.struct(F.col("variant").alias("rest"), F.col("text").alias("text"))

    def swap(acc, s):
        n = F.size(s["options"])
        pick = F.get(s["options"], F.pmod(acc["rest"], n.cast("bigint")).cast("int"))
        return F.struct(F.floor(acc["rest"] / n).cast("bigint").alias("rest"), F.replace(acc["text"], s["original"], pick).alias("text"))

    return rows.select("program", "variant", F.aggregate("_s", start, swap)["text"].alias("text"))


def expand_synonyms(table: DataFrame, key: str, synonyms: str, order: str) -> DataFrame:
    """One row per synonym of a class; the later write wins."""
    spread = table.withColumn(key, F.explode(F.array_distinct(F.concat(F.array(key), synonyms)))).drop(synonyms)
    return latest(spread, [key], order)


# The action family and the start state its first step implies.
FAMILIES = {"SwitchOn": "switch", "SwitchOff": "switch", "PlugIn": "plug", "PlugOut": "plug"}
START_STATES = {"SwitchOff": "is_on", "SwitchOn": "is_off", "PlugIn": "unplugged"}


def _family(action="action") -> Column:
    out = None
    for name, family in FAMILIES.items():
        out = F.when(F.col(action) == name, family) if out is None else out.when(F.col(action) == name, family)
    return out


def start_states(steps: DataFrame) -> DataFrame:
    """State of each object before the script, from the first step that changes it."""
    first = steps.withColumn("family", _family()).where("family IS NOT NULL").groupBy("script", "object", "family").agg(
        F.min_by("action", "step").alias("action")
    )
    state = None
    for action, name in START_STATES.items():
        hit = F.col("action") == action
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return first.withColumn("state", state).where("state IS NOT NULL").select("script", "object", "state")


def contradictions(steps: DataFrame, chunk_steps=100_000) -> DataFrame:
    """Steps that repeat the last change of the same object, such as switching off twice."""
    changes = steps.withColumn("family", _family()).where("family IS NOT NULL")
    before = scan(changes, ["script", "object", "family"], "step", chunk_of("step", chunk_steps), lag={"_was": "action"})
    return before.where(F.col("_was") == F.col("action")).select("script", "object", "step", "action")


def carried_context(steps: DataFrame, rooms, chunk_steps=100_000) -> DataFrame:
    """Room and object last walked to before or at each step."""
    walk = F.col("action") == "Walk"
    marked = steps.withColumn("_room", F.when(walk & F.col("object").isin(list(rooms)), F.col("object"))).withColumn(
        "_near", F.when(walk & ~F.col("object").isin(list(rooms)), F.col("object"))
    )
    out = scan(marked, ["script"], "step", chunk_of("step", chunk_steps), last={"room": "_room", "at_reach": "_near"})
    return out.drop("_room", "_near")


# The opposite of each start state.
OPPOSITES = {"is_on": "is_off", "is_off": "is_on", "open": "closed", "closed": "open", "plugged": "unplugged", "unplugged": "plugged"}


def perturb_states(facts: DataFrame, id: str, variants: int, p_drop=0.2, p_flip=0.3, seed=0) -> DataFrame:
    """``variants`` copies of the start states with facts dropped or turned around at random."""
    rows = facts.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants)))).withColumn("_u", uniform(seed, F.col(id), F.col("variant")))
    flipped = F.col("state")
    for state, other in OPPOSITES.items():
        flipped = F.when(F.col("state") == state, F.lit(other)).otherwise(flipped)
    kept = rows.where(F.col("_u") >= p_drop)
    return kept.withColumn("state", F.when(F.col("_u") < p_drop + p_flip, flipped).otherwise(F.col("state"))).drop("_u")
