import pytest

from pathspark.plans import templates
from pathspark.plans.templates import TEMPLATES, VALUE_PATHS
from pathspark.plans.types import faults, run_time_error
from pathspark.sources.bundles import resources

ROOT = "Bundle.entry.resource.where(resourceType = "


def test_all_templates_and_value_paths_are_well_typed():
    assert {t.template_id: faults(t.path()) for t in TEMPLATES.values() if faults(t.path())} == {}
    assert not [p for paths in VALUE_PATHS.values() for p in paths if faults(p)]


@pytest.mark.parametrize(
    ("path", "said", "at"),
    [
        (ROOT + "'Encounter' and periods.start = '2150').count()", "there is no periods", "periods"),
        (ROOT + "'Encounter').period.begin", "there is no begin", "begin"),
        (ROOT + "'Observation').valueQuantity.value.unit", "there is no unit", None),
        (ROOT + "'Observation' and valueQuantity.value > 'high').exists()", "> can't compare a number with text", None),
        (ROOT + "'Observation' and code = 'x').exists()", "= can't compare an element with parts with text", None),
        (ROOT + "'Encounter').period.resolve()", "period is no reference", None),
        (ROOT + "'Encounter').location.location.resolve().names", "there is no names", None),
        (ROOT + "'Condition' and encounter.resolve().status = 'x').count()", "there is no status", None),
        (ROOT + "'Encounter' and partOf.exists() and 'x').count()", "and has text", None),
        (ROOT + "'Encounter').where('x').count()", "where() asks for a truth value", None),
        (ROOT + "'Observation').valueQuantity.toDateTime()", "toDateTime() is of text", None),
        (ROOT + "'Observation').where(code.not()).count()", "not() is of a truth value", None),
        (ROOT + "'Wound').count()", "there are no resources of type Wound", "Wound"),
        ("Bundle.entry.resource.where(id = 'x').count()", "with one type", None),
        ("Patient.name", "begins with Bundle", None), ("a.(", "expected", None),
        (ROOT + "'Encounter' and %context.Bundle.entry.resource.where(resourceType = 'Condition').codes.exists()).count()", "there is no codes", None),
    ],
)
def test_faults_are_named(path, said, at):
    found = faults(path)
    assert len(found) == 1 and said in found[0] and (at is None or found[0].endswith(f"(at {path.index(at)})")), found


def test_tags():
    assert templates.tagged("count") and all(TEMPLATES[t].result == "count" for t in templates.tagged("count"))
    assert set(templates.tagged("Condition")) == {t for t, x in TEMPLATES.items() if x.resource == "Condition"}
    assert "has-drug-prescribed" in templates.tagged("drug_name") and templates.tagged("unheard of") == [] and {"value", "windowed", "picked"} <= set(templates.tags())


def test_run_time_errors(spark):
    res = resources(spark.createDataFrame([], "patient_id string, ord long, resource string"))
    q = spark.createDataFrame([("q", "p")], "question_id string, patient_id string")
    assert run_time_error(res, ROOT + "'Encounter').count()", q) == ""
    assert "drug_name" in run_time_error(res, TEMPLATES["has-drug-prescribed"].path(), q)
