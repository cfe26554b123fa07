"""What was predicted, by which model, with which settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name spaces of the vocabularies used.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PROV = "http://www.w3.org/ns/prov#"
MLS = "http://www.w3.org/ns/mls#"
BFO = "http://purl.obolibrary.org/obo/BFO_"
MEX_ALGO = "http://mex.aksw.org/mex-algo#"
MEX_CORE = "http://mex.aksw.org/mex-core#"
MEX_PERF = "http://mex.aksw.org/mex-perf#"
OWL = "http://www.w3.org/2002/07/owl#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
PART_OF = BFO + "0000050"
DC = "http://purl.org/dc/elements/1.1/"
BASE = "urn:study:"


def parse_model_info(df: DataFrame, text: str) -> DataFrame:
    """Add ``algorithm`` STRING and ``settings`` MAP of ``Name(key=value,...)``; both null for texts of another form."""
    good = F.col(text).rlike(r"^[A-Za-z0-9_]+\(.+\)$")
    name = F.regexp_extract(text, r"^([A-Za-z0-9_]+)\(", 1)
    items = F.split(F.regexp_extract(text, r"(?s)\((.*)\)", 1), ",")
    pairs = F.transform(items, lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("k"), F.trim(F.regexp_replace(s, "^[^=]*=?", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    return df.withColumns({"algorithm": F.when(good, name), "settings": F.when(good, F.map_from_entries(first))})


def triples(stages: DataFrame) -> DataFrame:
    """(s, p, o, o_type) of stages: each stage a prediction generated by a run of an implementation with its settings,
    with its label and confidence. Distinct; stages whose model is not stated have no run."""
    x = parse_model_info(stages, "modelinfo")
    stage = F.concat(F.lit(BASE + "stage/"), F.col("stage_id").cast("string"))
    trip = F.concat(F.lit(BASE + "trip/"), F.col("trip_id").cast("string"))
    run = F.concat(F.lit(BASE + "run/"), F.sha2("modelinfo", 256))
    made = F.concat(F.lit(BASE + "implementation/"), F.col("algorithm"))
    t = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_type"))
    base = F.array(
        t(stage, RDF_TYPE, F.lit(PROV + "Entity"), "iri"),
        t(stage, PROV + "wasDerivedFrom", trip, "iri"),
        t(stage, DC + "type", F.col("label"), "literal"),
        t(stage, MLS + "hasValue", F.col("prob").cast("string"), "literal"),
        t(stage, PROV + "wasGeneratedBy", F.when(F.col("algorithm").isNotNull(), run), "iri"),
        t(run, MLS + "executes", made, "iri"),
        t(made, RDF_TYPE, F.when(F.col("algorithm").isNotNull(), F.lit(MLS + "Implementation")), "iri"),
    )
    settings = F.transform(F.map_entries(F.coalesce("settings", F.create_map().cast("map<string,string>"))), lambda e: F.struct(run.alias("s"), F.concat(F.lit(BASE + "setting/"), e["key"]).alias("p"), e["value"].alias("o"), F.lit("literal").alias("o_type")))
    return x.select(F.inline(F.concat(base, settings))).where("s is not null and o is not null").distinct()


def _text(*parts: Column | str) -> Column:
    return F.concat(F.lit(BASE), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _triple(s: Column, p: str, o: Column | str, kind: str = "iri") -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o.cast("string")).alias("o"), F.lit(kind).alias("o_type"))


def _flat(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows))).where("s is not null and o is not null")


def study_graph(
    spark: SparkSession, study: str, experiment: str, settings: dict[str, str], trips: DataFrame, predicted: DataFrame, errors: list[str] = (), removed_outliers: int = 0, merged: bool = False
) -> DataFrame:
    """(s, p, o, o_type), distinct: a whole experiment. ``settings`` are those of the trip detection, with its name under
    ``detector``; ``trips`` holds (user, trip, start_t, end_t); ``predicted`` (user, trip, window, label, prob, modelinfo).

    The study has the experiment, which has its hyperparameters, errors and number of outliers and was made for its
    users. A trip is an activity of its user, generated by the detector, with a data set of positions and one of
    accelerations; each prediction is a run of an implementation on a window of the latter, with its settings, that puts
    out a mode and a confidence. Guessed predictions are runs of a guess. Nulls give no triple."""
    st, ex, detector = _text("study/", study), _text("experiment/", experiment), _text("implementation/", settings.get("detector", "detector"))
    fixed = [
        _triple(st, RDF_TYPE, MLS + "Study"), _triple(ex, RDF_TYPE, MLS + "Experiment"), _triple(st, MLS + "hasPart", ex),
        _triple(_text("PositionData"), RDFS + "subClassOf", MLS + "Dataset"), _triple(_text("AccelerationData"), RDFS + "subClassOf", MLS + "Dataset"),
        _triple(_text("PositionData"), RDF_TYPE, OWL + "Class"), _triple(_text("AccelerationData"), RDF_TYPE, OWL + "Class"),
        _triple(_text("confidence"), RDF_TYPE, MLS + "EvaluationMeasure"), _triple(detector, RDF_TYPE, MLS + "Implementation"),
        _triple(detector, MLS + "implements", _text("algorithm/", settings.get("detector", "detector"))), _triple(_text("algorithm/", settings.get("detector", "detector")), RDF_TYPE, MEX_ALGO + "UnsupervisedApproach"),
        _triple(ex, BASE + "removedOutliers", F.lit(removed_outliers), "literal"), _triple(ex, BASE + "tripsMerged", F.lit(str(merged).lower()), "literal"),
        *[_triple(ex, BASE + "error", F.lit(e), "literal") for e in errors],
    ]
    for name, value in settings.items():
        if name != "detector":
            parameter, setting = _text(f"parameter/{study}/{experiment}/{name}"), _text(f"setting/{study}/{experiment}/{name}")
            fixed += [
                _triple(detector, MLS + "hasHyperParameter", parameter), _triple(parameter, RDF_TYPE, MLS + "HyperParameter"),
                _triple(setting, RDF_TYPE, MLS + "HyperParameterSetting"), _triple(setting, MLS + "specifiedBy", parameter), _triple(setting, MLS + "hasValue", F.lit(value), "literal"),
            ]
    key = (f"{study}/{experiment}/", F.col("user"), "/", F.col("trip"))
    user, activity = _text("user/", F.col("user")), _text("trip/", *key)
    when = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    trip = [
        _triple(user, RDF_TYPE, PROV + "Person"), _triple(ex, DC + "creator", user), _triple(activity, RDF_TYPE, PROV + "Activity"),
        _triple(_text("positions/", *key), RDF_TYPE, _text("PositionData")), _triple(_text("accelerations/", *key), RDF_TYPE, _text("AccelerationData")),
        _triple(activity, PROV + "used", _text("positions/", *key)), _triple(activity, PROV + "startedAtTime", when("start_t"), "literal"), _triple(activity, PROV + "endedAtTime", when("end_t"), "literal"),
        _triple(activity, PROV + "wasAssociatedWith", user), _triple(activity, PROV + "wasGeneratedBy", detector), _triple(detector, PROV + "wasAttributedTo", user),
    ]
    own = (*key, "/", F.col("window"))
    run, window, made, sure = (_text(name + "/", *own) for name in ("run", "window", "prediction", "confidence"))
    guessed = F.col("modelinfo") == "guessed"
    code = _text("implementation/", F.when(guessed, "guess").otherwise(F.col("algorithm")))
    prediction = [
        _triple(run, RDF_TYPE, MLS + "Run"), _triple(window, RDF_TYPE, MLS + "Data"), _triple(window, PART_OF, _text("accelerations/", *key)), _triple(run, MLS + "hasInput", window),
        _triple(made, RDF_TYPE, MEX_PERF + "ExamplePerformance"), _triple(made, RDFS + "label", F.col("label"), "literal"), _triple(run, MLS + "hasOutput", made),
        _triple(sure, RDF_TYPE, MLS + "ModelEvaluation"), _triple(sure, MLS + "specifiedBy", _text("confidence")), _triple(sure, MLS + "hasValue", F.col("prob"), "literal"), _triple(run, MLS + "hasOutput", sure),
        _triple(run, MLS + "executes", code), _triple(code, RDF_TYPE, MLS + "Implementation"), _triple(code, MLS + "implements", _text("algorithm/", F.when(guessed, "guess").otherwise(F.col("algorithm")))),
    ]
    p = parse_model_info(predicted, "modelinfo")
    e = p.where("settings is not null").select("algorithm", F.explode("settings").alias("k", "v"))
    code2, parameter, setting = _text("implementation/", F.col("algorithm")), _text("parameter/", F.col("algorithm"), "/", F.col("k")), _text("setting/", F.col("algorithm"), "/", F.col("k"), "=", F.col("v"))
    hyper = [
        _triple(code2, MLS + "hasHyperParameter", parameter), _triple(parameter, RDF_TYPE, MLS + "HyperParameter"),
        _triple(setting, RDF_TYPE, MLS + "HyperParameterSetting"), _triple(setting, MLS + "specifiedBy", parameter), _triple(setting, MLS + "hasValue", F.col("v"), "literal"),
    ]
    every = _flat(spark.range(1), fixed).unionByName(_flat(trips, trip)).unionByName(_flat(p, prediction)).unionByName(_flat(e.distinct(), hyper))
    return every.distinct()


def unmatched_trips(trips: DataFrame, predicted: DataFrame) -> DataFrame:
    """(user, trip) of trips without predictions and of predictions without a trip: none may be left when a run is closed."""
    a, b = trips.select("user", "trip").distinct(), predicted.select("user", "trip").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def turtle_lines(df: DataFrame) -> DataFrame:
    """(value): one N-Triples line, which is Turtle too, per triple."""
    o = F.when(F.col("o_type") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return df.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def run_record(settings: dict[str, str], errors: list[str], removed_outliers: int) -> str:
    """The record of a run as JSON."""
    import json

    return json.dumps({"settings": settings, "errors": errors, "numRemovedOutliers": removed_outliers}, sort_keys=True)
