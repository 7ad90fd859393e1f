"""Scores of series answers by ability, as expressions.

Every scorer returns ``struct<categorical: array<double>, numerical: array<double>, reason: array<double>>``. Reason
scores that need keywords picked by a model come in as a column (``reason``), usually from keyword recall.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.draws import let
from tidewright.functions.text import NUMBER, first_number, metric_key, names_metric, period_sentences, relative_score, sentences
from tidewright.operators.relational import set_f1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bit(ok) -> Column:
    return F.coalesce(ok, F.lit(False)).cast("double")


def _result(categorical=(), numerical=(), reason=()) -> Column:
    pack = lambda v: F.array(*v) if isinstance(v, (list, tuple)) and v else (v if isinstance(v, Column) else F.array().cast("array<double>"))
    return F.struct(pack(categorical).alias("categorical"), pack(numerical).alias("numerical"), pack(reason).alias("reason"))


def _head(clauses) -> Column:
    return F.coalesce(F.lower(F.get(clauses, F.lit(0))), F.lit(""))


def _said_near(clauses, words, lower=False) -> Column:
    """First number of the first clause that has one and names one of the words."""
    text = (lambda s: F.lower(s)) if lower else (lambda s: s)

    def fits(s):
        named = F.lit(False)
        for word in words:
            named = named | F.contains(text(s), F.lit(word))
        return named & s.rlike(NUMBER)

    return first_number(F.get(F.filter(clauses, fits), F.lit(0)))


def _closeness(said, true) -> Column:
    return let(said, lambda v: F.when(v.isNull(), 0.0).otherwise(relative_score(v, true)))


def trend(answer, kind, start, amplitude) -> Column:
    """Direction, start value and change of a trend answer."""
    kind = _c(kind)

    def judge(s):
        first = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
        right = (
            F.when(F.contains(kind, F.lit("steady")), F.contains(first, F.lit("steady")))
            .when(F.contains(kind, F.lit("decrease")), F.contains(F.lower(first), F.lit("decreas")))
            .when(F.contains(kind, F.lit("increase")), F.contains(F.lower(first), F.lit("increas")))
            .otherwise(False)
        )
        begin = _closeness(_said_near(s, ["start"]), _c(start))
        change = _closeness(_said_near(s, ["change value", "from left to right"]), _c(amplitude))
        numbers = F.when(F.size(s) == 0, F.array(F.lit(0.0))).when(kind == "keep steady", F.array(begin)).otherwise(F.array(begin, change))
        return _result([_bit(right)], numbers)

    return let(sentences(answer), judge)


def season(answer, kind, period, amplitude) -> Column:
    """Periodicity, period length and amplitude of a season answer."""
    kind = _c(kind)

    def judge(s):
        none = F.contains(kind, F.lit("no"))
        head = _head(s)
        right = F.when(none, F.contains(head, F.lit("no periodic"))).otherwise(~F.contains(head, F.lit("no")) & F.contains(head, F.lit("periodic")))
        length = _closeness(_said_near(s, ["each period"]), _c(period))
        height = _closeness(_said_near(s, ["amplitude"]), _c(amplitude))
        flat = kind == "no periodic fluctuation"
        numbers = F.when(F.size(s) == 0, F.array(F.lit(0.0))).when(flat, F.array().cast("array<double>")).otherwise(F.array(length, height))
        return _result([_bit(right & (F.size(s) > 0))], numbers)

    return let(sentences(answer), judge)


def noise(answer, kind, std) -> Column:
    """Noisiness and deviation of a noise answer."""
    kind = _c(kind)

    def judge(s):
        quiet = F.contains(kind, F.lit("almost no"))
        right = F.when(quiet, F.contains(_head(s), F.lit("no noise"))).otherwise(F.contains(_head(s), F.lit("noisy")))
        spread = _closeness(_said_near(s, ["standard", "std"], lower=True), _c(std))
        numbers = F.when(F.size(s) == 0, F.array(F.lit(0.0))).when(F.contains(kind, F.lit("noisy")), F.array(spread)).otherwise(F.array().cast("array<double>"))
        return _result([_bit(right)], numbers)

    return let(sentences(answer), judge)


def _facts(answer) -> Column:
    return F.transform(F.split(_c(answer), "[;；]", -1), lambda f: F.struct(f.alias("text"), F.split(f, "[，。,;；]", -1).alias("clauses")))


def _local_hit(answer, feature) -> Column:
    """First fact of an answer that names the change and puts it within 64 steps: matched, scores, text."""
    start = F.struct(F.lit(False).alias("hit"), F.lit(0.0).alias("position"), F.lit(0.0).alias("amplitude"))

    def read(acc, clause):
        def told(c):
            said = c["said"]
            named = F.contains(c["low"], F.lit("position")) | F.contains(c["low"], F.lit("around point"))
            far = named & (F.abs(said - feature["position"]) > 64)
            place = said.isNotNull() & named & ~far
            hit = acc["hit"] | F.coalesce(place, F.lit(False))
            tall = said.isNotNull() & ~F.coalesce(far, F.lit(False)) & hit & F.contains(c["low"], F.lit("amplitude"))
            return F.struct(
                hit.alias("hit"),
                F.when(place, relative_score(said, feature["position"])).otherwise(acc["position"]).alias("position"),
                F.when(tall, relative_score(said, feature["amplitude"])).otherwise(acc["amplitude"]).alias("amplitude"),
            )

        return let(F.struct(first_number(clause).alias("said"), F.lower(clause).alias("low")), told)

    def judge(fact):
        head = F.lower(F.get(fact["clauses"], F.lit(0)))
        named = F.exists(feature["types"], lambda t: F.contains(head, t))
        return F.struct(F.when(named, F.aggregate(fact["clauses"], start, read)).otherwise(start).alias("s"), fact["text"].alias("text"))

    judged = F.transform(_facts(answer), judge)
    return F.get(F.filter(judged, lambda j: j["s"]["hit"]), F.lit(0))


def local(answer, features) -> Column:
    """Local changes: ``features`` is ``array<struct<types: array<string>, position: double, amplitude: double>>``."""
    hits = F.transform(_c(features), lambda f: F.struct(_local_hit(answer, f).alias("h")))

    return let(hits, _local_result)


def _local_result(hits) -> Column:
    found = F.transform(hits, lambda h: _bit(h["h"].isNotNull()))
    numbers = F.flatten(F.transform(hits, lambda h: F.array(F.coalesce(h["h"]["s"]["position"], F.lit(0.0)), F.coalesce(h["h"]["s"]["amplitude"], F.lit(0.0)))))
    return _result(found, numbers)


def local_explained(answer, features, reason) -> Column:
    """Local changes with an explanation score per feature; a missed feature scores 0."""

    def judge(base):  # the facts are matched once, not for each field
        told = F.zip_with(base["categorical"], _c(reason), lambda hit, r: F.when(hit > 0, F.coalesce(r, F.lit(0.0))).otherwise(0.0))
        return F.struct(base["categorical"].alias("categorical"), base["numerical"].alias("numerical"), told.alias("reason"))

    return let(local(answer, features), judge)


def explanation_of(answer, feature) -> Column:
    """Last period sentence of the matched fact, the part that explains the change."""
    return F.element_at(period_sentences(_local_hit(answer, feature)["text"]), -1)


def _yes_no(head, label) -> Column:
    return F.when(_c(label), F.contains(head, F.lit("yes"))).otherwise(F.contains(head, F.lit("no")))


def shape_correlation(answer, label, reason) -> Column:

    def judge(s):
        right = _yes_no(_head(s), label) & (F.size(s) > 0)
        return _result([_bit(right)], (), [F.when(F.size(s) > 0, F.coalesce(_c(reason), F.lit(0.0))).otherwise(0.0)])

    return let(sentences(answer), judge)


def _answer_pairs(text, cols) -> Column:
    """``metric,detail`` pairs of a text for every metric name that is mentioned."""
    items = F.filter(F.transform(F.split(text, ";", -1), lambda f: F.split(F.trim(f), ",", -1)), lambda i: F.size(i) == 2)
    per_item = F.transform(
        items,
        lambda i: F.transform(
            F.filter(_c(cols), lambda c: F.contains(metric_key(F.trim(i[0])), metric_key(c))), lambda c: F.concat(c, F.lit("\u0001"), F.trim(i[1]))
        ),
    )
    return F.array_distinct(F.flatten(per_item))


def _pair_keys(pairs) -> Column:
    return F.array_distinct(F.transform(_c(pairs), lambda p: F.concat(p["metric"], F.lit("\u0001"), p["detail"])))


def local_correlation(answer, label, pairs, cols, reason) -> Column:
    """Yes with exactly the labelled (metric, detail) pairs, or no."""

    def judge(s):
        got, want = F.array_sort(_answer_pairs(F.coalesce(F.get(s, F.lit(1)), F.lit("")), cols)), F.array_sort(_pair_keys(pairs))
        right = F.when(_c(label), F.contains(_head(s), F.lit("yes")) & (got == want)).otherwise(F.contains(_head(s), F.lit("no")))
        return _result([_bit(right & (F.size(s) > 0))], (), [F.when(F.size(s) > 0, F.coalesce(_c(reason), F.lit(0.0))).otherwise(0.0)])

    return let(period_sentences(answer), judge)


def shape_cluster(answer, members, cols, reason) -> Column:
    """F1 of the named metrics against the cluster's."""

    def judge(s):
        facts = F.split(F.coalesce(F.get(s, F.lit(0)), F.lit("")), ",", -1)
        named = F.filter(_c(cols), lambda c: F.exists(facts, lambda f: F.contains(metric_key(F.trim(f)), metric_key(c))))
        return _result([set_f1(named, F.array_distinct(_c(members)))], (), [F.when(F.size(s) > 0, F.coalesce(_c(reason), F.lit(0.0))).otherwise(0.0)])

    return let(period_sentences(answer), judge)


def local_cluster(answer, pairs, cols, reason) -> Column:
    """F1 of the named (metric, detail) pairs against the cluster's."""

    def judge(s):
        got = _answer_pairs(F.coalesce(F.get(s, F.lit(0)), F.lit("")), cols)
        return _result([set_f1(got, _pair_keys(pairs))], (), [F.when(F.size(s) > 0, F.coalesce(_c(reason), F.lit(0.0))).otherwise(0.0)])

    return let(period_sentences(answer), judge)


def deductive(answer, label, reason) -> Column:
    """Yes/no labels compare first clauses, other labels take the keyword score."""
    want, got = _head(sentences(label)), _head(sentences(answer))
    return _result((), (), [F.when(want.isin("yes", "no"), _bit(want == got)).otherwise(F.coalesce(_c(reason), F.lit(0.0)))])


def causal(answer, label) -> Column:
    return _result((), (), [_bit(names_metric(_head(sentences(label)), _head(sentences(answer))))])


def multiple_choice(answer, label) -> Column:
    return _result((), (), [_bit(names_metric(label, answer))])
