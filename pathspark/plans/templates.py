"""The 61 query templates: each a path over %parameters, so that one plan answers a template for all patients and questions.

Inside a path, during() is the question's time window (lo, hi) over the event time; pick() is its first or last resource by event
time; extreme() keeps all resources that tie for the first or last time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..schema import ICU, MICRO_TEST, ORGANISM, WEIGHTS

# Predicates of the placeholders.
_LAB = "category.coding.code = 'laboratory'"
_OUTPUT = "category.coding.code = 'Output'"
_ICU_INPUT = f"context.resolve().identifier.system = '{ICU}'"
_DISPLAY = "code.coding.display = %{}"
_DRUG = "(medicationReference.resolve().identifier.where(value = %{0}).exists() or medicationCodeableConcept.coding.where(code = %{0}).exists())"
_SPEC = "specimen.resolve().type.coding.where(code = %spec_name or display = %spec_name).exists()"
_INPUT = f"{_ICU_INPUT} and medicationCodeableConcept.coding.display = %input_name"
_ROUTE = "dosageInstruction.route.coding.code = %drug_route"
_NORMAL = (
    "valueQuantity.value.convertsToQuantity() and (referenceRange.low.value.exists() implies valueQuantity.value >= referenceRange.low.value)"
    " and (referenceRange.high.value.exists() implies valueQuantity.value <= referenceRange.high.value)"
)
_DRUG_NAMES = "select(medicationReference.resolve().identifier.value | medicationCodeableConcept.coding.code)"


@dataclass(frozen=True)
class Template:
    template_id: str
    resource: str
    criteria: tuple[str, ...]
    then: str
    window: bool
    result: str  # count, boolean, list, instant, value
    subject: str  # what the question is about
    slots: tuple[str, ...]

    @property
    def exact(self) -> bool:
        return "pick()" in self.then or "extreme()" in self.then

    def path(self) -> str:
        tests = [f"resourceType = '{self.resource}'", *map(_compared, self.criteria), *(["during()"] if self.window else [])]
        return f"Bundle.entry.resource.where({' and '.join(tests)}).{self.then}"

    def text(self) -> str:
        """The question, with {slots} for values and [slots] for time expressions."""
        time = " [time_filter_global1]" if self.window else ""
        pick = " [time_filter_exact1]" if self.exact else ""
        who = "patient {patient_id}"
        if self.template_id.startswith("patient-"):
            return f"What is the {self.subject} of {who}?"
        return {
            "count": f"How many {self.subject} are on record for {who}{time}?",
            "boolean": f"Is there any {self.subject}{pick} on record for {who}{time}?",
            "list": f"List the {self.subject} of {who}{time}.",
            "instant": f"When was the{pick} {self.subject} of {who}{time}?",
            "value": f"What was the{pick} {self.subject} of {who}{time}?",
        }[self.result]


_TIME = {"Observation": "effectiveDateTime.toDateTime()", "MedicationAdministration": "select((effectiveDateTime | effectivePeriod.start).sort().first().toDateTime())", "MedicationRequest": "authoredOn.toDateTime()", "Procedure": "select((performedDateTime | performedPeriod.start).sort().first().toDateTime())", "Encounter": "select((period.start | period.end).sort().first().toDateTime())", "Condition": "encounter.resolve().period.start.toDateTime()"}
TEMPLATES: dict[str, Template] = {}
#: Comparison operations of the operation slot, as the path language writes them.
OPERATIONS = {"greater": ">", "less": "<"}


def register_operation(name: str, symbol: str) -> None:
    """Adds a comparison, which questions may draw from then on."""
    if name in OPERATIONS:
        raise ValueError(f"operation {name} is registered already")
    if symbol not in (">", "<", ">=", "<=", "="):
        raise ValueError(f"{symbol} is no comparison")
    OPERATIONS[name] = symbol


def _compared(criterion: str) -> str:
    """A criterion with %comparison(element, value) written out for all operations."""
    each = lambda m: "(" + " or ".join(f"(%comparison = '{name}' and {m[1]} {symbol} {m[2]})" for name, symbol in OPERATIONS.items()) + ")"
    return re.sub(r"%comparison\(([^,()]+), ([^,()]+)\)", each, criterion)


def register_template(template_id: str, resource: str, criteria: list[str] | str, then: str, result: str, subject: str, window: bool = True) -> Template:
    """Adds a template. Its slots are the parameters of its path."""
    if template_id in TEMPLATES:
        raise ValueError(f"template {template_id} is registered already")
    tests = (criteria,) if isinstance(criteria, str) else tuple(criteria)
    names = dict.fromkeys(m for t in (*tests, then) for m in re.findall(r"%(\w+)", t) if m != "context")
    TEMPLATES[template_id] = t = Template(template_id, resource, tests, then, window, result, subject, ("patient_id", *names))
    return t


def tags_of(t: Template) -> tuple[str, ...]:
    """What templates are found by: their result, resource type and slots, and whether they have a window, or pick one resource."""
    return (t.result, t.resource, *t.slots[1:], *(["windowed"] if t.window else []), *(["picked"] if t.exact else []))


def tagged(tag: str) -> list[str]:
    """The ids of the templates with a tag."""
    return [k for k, t in TEMPLATES.items() if tag in tags_of(t)]


def tags() -> list[str]:
    return sorted({x for t in TEMPLATES.values() for x in tags_of(t)})


def _all() -> None:
    add = register_template
    enc, obs, mr, ma, proc, cond = "Encounter", "Observation", "MedicationRequest", "MedicationAdministration", "Procedure", "Condition"
    root, icu = "partOf.empty()", f"identifier.system = '{ICU}'"
    organism, micro = f"code.coding.system = '{ORGANISM}'", f"code.coding.system = '{MICRO_TEST}'"
    out, lab, vital, procedure, diagnosis = (_DISPLAY.format(f"{x}_name") for x in ("output", "lab", "vital", "procedure", "diagnosis"))
    drug = _DRUG.format("drug_name")
    add("count-drugs-prescribed", mr, [], "select(medicationReference.resolve() | medicationCodeableConcept).distinct().count()", "count", "different prescribed drugs")
    add("count-hospital-visits", enc, root, "count()", "count", "hospital visits")
    add("count-icu-visits", enc, icu, "count()", "count", "ICU visits")
    add("count-input-intake-events", ma, _INPUT, "count()", "count", "{input_name} intakes")
    add("count-output-events", obs, out, "count()", "count", "{output_name} outputs")
    add("count-lab-test-events", obs, [_LAB, lab], "count()", "count", "{lab_name} lab tests")
    add("count-procedure-events", proc, procedure, "count()", "count", "{procedure_name} procedures")
    add("count-specific-drug-prescriptions", mr, drug, "count()", "count", "prescriptions of {drug_name}")
    add("has-hospital-admission", enc, root, "exists()", "boolean", "hospital admission")
    add("has-diagnosis", cond, diagnosis, "exists()", "boolean", "diagnosis of {diagnosis_name}")
    add("has-drug-prescribed", mr, drug, "exists()", "boolean", "prescription of {drug_name}")
    add("has-multiple-drugs-or", mr, "(" + " or ".join(_DRUG.format(f"drug_name{i}") for i in (1, 2, 3)) + ")", "exists()", "boolean", "prescription of {drug_name1}, {drug_name2} or {drug_name3}")
    add("has-any-medication", mr, [], "exists()", "boolean", "prescription")
    add("has-emergency-room-visit", enc, "class.code = 'EMER'", "exists()", "boolean", "emergency room visit")
    add("has-input-intake", ma, _INPUT, "exists()", "boolean", "{input_name} intake")
    add("has-output-events", obs, out, "exists()", "boolean", "{output_name} output")
    add("has-micro-test-specific", obs, [organism, f"derivedFrom.resolve().{_SPEC}"], "exists()", "boolean", "microbiology result for {spec_name}")
    add("has-micro-test-any", obs, organism, "exists()", "boolean", "microbiology result")
    add("has-lab-test", obs, [_LAB, lab], "exists()", "boolean", "{lab_name} lab test")
    add("has-procedure", proc, procedure, "exists()", "boolean", "{procedure_name} procedure")
    add("has-any-diagnosis", cond, [], "exists()", "boolean", "diagnosis")
    add("has-any-lab-test", obs, _LAB, "exists()", "boolean", "lab test")
    add("has-any-procedure", proc, [], "exists()", "boolean", "procedure")
    add("has-vital-comparison", obs, [vital, "%comparison(valueQuantity.value, %vital_value)"], "exists()", "boolean", "{vital_name} (comparison1) than {vital_value}")
    add("has-normal-vital", obs, [vital, _NORMAL], "exists()", "boolean", "normal {vital_name}")
    add("has-organism-found", obs, _SPEC, f"pick().where(hasMember.exists() and hasMember.resolve().{organism}).exists()", "boolean", "organism in the {spec_name} test")
    add("list-admission-times", enc, root, "period.start", "list", "hospital admission times")
    add("time-micro-test-specific", obs, [_LAB, _SPEC], f"pick().{_TIME[obs]}", "instant", "microbiology test of {spec_name}")
    add("time-hospital-admission", enc, root, f"pick().{_TIME[enc]}", "instant", "hospital admission", False)
    add("time-admission-route", enc, [root, "hospitalization.admitSource.coding.code = %admission_route"], "pick().select((period.start | period.end).first())", "instant", "admission by {admission_route}", False)
    add("time-hospital-discharge", enc, root, "pick().period.end", "instant", "hospital discharge", False)
    for name, kind, test, noun in (
        ("intake", ma, [], "intake"), ("lab-test", obs, "category.coding.code.lower() = 'laboratory'", "lab test"), ("micro-test", obs, micro, "microbiology test"), ("prescription", mr, [], "prescription"),
    ):
        add(f"time-{name}", kind, test, f"pick().{_TIME[kind]}", "instant", noun)
    add("time-procedure", proc, [], "pick().performed", "instant", "procedure")
    for name, kind, test, noun in (
        ("specific-intake", ma, _INPUT, "intake of {input_name}"), ("specific-output", obs, [_OUTPUT, out], "output of {output_name}"), ("vital-measurement", obs, vital, "measurement of {vital_name}"), ("specific-lab", obs, [_LAB, lab], "lab test of {lab_name}"),
        ("specific-procedure", proc, procedure, "{procedure_name} procedure"), ("specific-diagnosis", cond, diagnosis, "diagnosis of {diagnosis_name}"), ("specific-drug", mr, drug, "prescription of {drug_name}"), ("drug-route", mr, _ROUTE, "prescription by route {drug_route}"),
    ):
        add(f"time-{name}", kind, test, f"pick().{_TIME[kind]}", "instant", noun)
    add("patient-birth-date", "Patient", [], "birthDate", "value", "birth date", False)
    add("patient-gender", "Patient", [], "gender", "value", "gender", False)
    add("careunit", enc, [], "pick().location.pick().location.resolve().name", "value", "care unit")
    add("admission-type", enc, root, "pick().type.coding.display", "value", "type of admission", False)
    add("vital-measurement", obs, vital, "pick().valueQuantity.value", "value", "measured {vital_name}")
    add("lab-measurement", obs, [_LAB, lab], "pick().valueQuantity.value", "value", "measured {lab_name}")
    add("weight", obs, "code.coding.display in {" + ", ".join(f"'{w}'" for w in WEIGHTS) + "}", "pick().select(valueQuantity.value | valueQuantity.unit)", "value", "weight")
    add("drug-dose", mr, drug, "pick().dosageInstruction.doseAndRate.doseQuantity.value", "value", "dose of {drug_name}")
    add("diagnosis-name", cond, [], "extreme().code.coding.display", "value", "diagnosis")
    add("drug-name", mr, [], f"pick().{_DRUG_NAMES}", "value", "prescribed drug")
    add("drug-name-route", mr, _ROUTE, f"pick().{_DRUG_NAMES}", "value", "drug prescribed by route {drug_route}")
    for name, kind, test, noun in (("lab-name", obs, _LAB, "lab test"), ("micro-test-name", obs, micro, "microbiology test"), ("output-name", obs, _OUTPUT, "output"), ("procedure-name", proc, [], "procedure")):
        add(name, kind, test, "pick().code.coding.display", "value", f"name of the {noun}")
    add("specimen-name", obs, "specimen.exists()", "pick().specimen.resolve().type.coding.select(code | display)", "value", "specimen")
    add("organism-name", obs, [_LAB, _SPEC, "hasMember.exists()"], "pick().hasMember.resolve().code.coding.display", "value", "organism found in {spec_name}")


_all()
#: How a patient's own values for a slot are found, by slot.
VALUE_PATHS: dict[str, tuple[str, ...]] = {
    "drug_name": ("Bundle.entry.resource.where(resourceType = 'Medication').identifier.value", f"Bundle.entry.resource.where(resourceType = 'MedicationRequest').{_DRUG_NAMES}"),
    "procedure_name": ("Bundle.entry.resource.where(resourceType = 'Procedure').code.coding.display",),
    "admission_route": ("Bundle.entry.resource.where(resourceType = 'Encounter').hospitalization.admitSource.coding.code",),
    "careunit": ("Bundle.entry.resource.where(resourceType = 'Encounter').location.location.resolve().name",),
    "diagnosis_name": ("Bundle.entry.resource.where(resourceType = 'Condition').code.coding.display",),
    "drug_route": ("Bundle.entry.resource.where(resourceType = 'MedicationRequest').dosageInstruction.route.coding.code",),
    "gender": ("Bundle.entry.resource.where(resourceType = 'Patient').gender",),
    "input_name": (f"Bundle.entry.resource.where(resourceType = 'MedicationAdministration' and {_ICU_INPUT}).medicationCodeableConcept.coding.display",),
    "lab_name": (f"Bundle.entry.resource.where(resourceType = 'Observation' and {_LAB}).code.coding.display",),
    "output_name": (f"Bundle.entry.resource.where(resourceType = 'Observation' and {_OUTPUT}).code.coding.display",),
    "spec_name": ("Bundle.entry.resource.where(resourceType = 'Specimen').type.coding.select(code | display)",),
    "vital_name": ("Bundle.entry.resource.where(resourceType = 'Observation').code.coding.display",),
    "vital_value": ("Bundle.entry.resource.where(resourceType = 'Observation').valueQuantity.value",),
    "lab_value": (f"Bundle.entry.resource.where(resourceType = 'Observation' and {_LAB}).valueQuantity.value",),
    "blank": (), "patient_id": (),
}
#: The criterion that a placeholder puts on a resource; %value stands for its value. Empty: none, as the document is the patient's own.
PLACEHOLDERS: dict[str, dict[str, str]] = {
    "blank": {}, "patient_id": {}, "gender": {},
    "drug_name": {"Medication": "identifier.where(value = %value).exists()", "MedicationRequest": _DRUG.format("value")},
    "procedure_name": {"Procedure": _DISPLAY.format("value")},
    "admission_route": {"Encounter": "hospitalization.admitSource.coding.code = %value"},
    "careunit": {"Encounter": "location.where(location.resolve().name = %value).exists()"},
    "diagnosis_name": {"Condition": _DISPLAY.format("value")},
    "drug_route": {"MedicationRequest": "dosageInstruction.route.coding.code = %value"},
    "input_name": {"MedicationAdministration": f"{_ICU_INPUT} and medicationCodeableConcept.coding.display = %value"},
    "lab_name": {"Observation": f"{_LAB} and {_DISPLAY.format('value')}"},
    "output_name": {"Observation": _DISPLAY.format("value")},
    "spec_name": {"Observation": _SPEC.replace("%spec_name", "%value"), "Specimen": "type.coding.where(code = %value or display = %value).exists()"},
    "vital_name": {"Observation": _DISPLAY.format("value")},
    "vital_value": {"Observation": "valueQuantity.value = %value"}, "lab_value": {"Observation": "valueQuantity.value = %value"},
}


def register_placeholder(name: str, criteria: dict[str, str], value_paths: tuple[str, ...] = ()) -> None:
    """Adds a placeholder: its criterion by resource type, and the paths that find a patient's values for it."""
    if name in PLACEHOLDERS:
        raise ValueError(f"placeholder {name} is registered already")
    PLACEHOLDERS[name], VALUE_PATHS[name] = dict(criteria), tuple(value_paths)


def placeholder_path(name: str, resource: str) -> str:
    """The path of the resources that a placeholder's value selects; the question's column is `value`."""
    criterion = PLACEHOLDERS[name].get(resource)
    return f"Bundle.entry.resource.where(resourceType = '{resource}'{' and ' + criterion if criterion else ''} and during())"
