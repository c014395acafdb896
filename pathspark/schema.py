"""The declared schemas of the clinical resources that the templates read, and where their references point."""

from __future__ import annotations

import re

from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

_CODING = "struct<system:string,code:string,display:string>"
_CONCEPT = f"struct<coding:array<{_CODING}>,text:string>"
_IDENTIFIER = "array<struct<system:string,value:string>>"
_REFERENCE = "struct<reference:string>"
_PERIOD = "struct<start:string,end:string>"

_DDL = {
    "Patient": f"id string, birthDate string, gender string, identifier {_IDENTIFIER}",
    "Encounter": f"id string, period {_PERIOD}, partOf {_REFERENCE}, identifier {_IDENTIFIER}, class {_CODING}, type array<{_CONCEPT}>, hospitalization struct<admitSource:{_CONCEPT}>, location array<struct<location:{_REFERENCE},period:{_PERIOD}>>",
    "Observation": f"id string, effectiveDateTime string, category array<{_CONCEPT}>, code {_CONCEPT}, valueQuantity struct<value:double,unit:string>, valueString string, referenceRange array<struct<low:struct<value:double>,high:struct<value:double>>>, specimen {_REFERENCE}, hasMember array<{_REFERENCE}>, derivedFrom array<{_REFERENCE}>, encounter {_REFERENCE}",
    "Condition": f"id string, code {_CONCEPT}, encounter {_REFERENCE}",
    "Procedure": f"id string, code {_CONCEPT}, performedDateTime string, performedPeriod {_PERIOD}, encounter {_REFERENCE}",
    "Medication": f"id string, identifier {_IDENTIFIER}, code {_CONCEPT}",
    "MedicationRequest": f"id string, authoredOn string, medicationReference {_REFERENCE}, medicationCodeableConcept {_CONCEPT}, dosageInstruction array<struct<route:{_CONCEPT},doseAndRate:array<struct<doseQuantity:struct<value:double,unit:string>>>>>, encounter {_REFERENCE}",
    "MedicationAdministration": f"id string, effectiveDateTime string, effectivePeriod {_PERIOD}, context {_REFERENCE}, medicationCodeableConcept {_CONCEPT}",
    "Specimen": f"id string, type {_CONCEPT}",
    "Location": "id string, name string",
}


def from_ddl(ddl: str) -> StructType:
    """The few types that are used here, read without a session."""
    tokens = re.findall(r"\w+|[<>:,]", ddl)
    plain = {"string": StringType(), "double": DoubleType(), "long": LongType(), "int": IntegerType()}

    def kind() -> DataType:
        name = tokens.pop(0)
        if name in plain:
            return plain[name]
        tokens.pop(0)  # <
        if name == "struct":
            made: DataType = fields(">")
        elif name == "array":
            made = ArrayType(kind())
        else:
            key = kind()
            tokens.pop(0)
            made = MapType(key, kind())
        tokens.pop(0)  # >
        return made

    def fields(end: str | None) -> StructType:
        out = StructType()
        while tokens and tokens[0] != end:
            if tokens[0] == ",":
                tokens.pop(0)
            name = tokens.pop(0)
            if tokens[0] == ":":
                tokens.pop(0)
            out = out.add(name, kind())
        return out

    return fields(None)


RESOURCES: dict[str, StructType] = {k: from_ddl(v) for k, v in _DDL.items()}
#: What a reference element points to.
TARGETS = {"medicationReference": "Medication", "encounter": "Encounter", "context": "Encounter", "partOf": "Encounter", "specimen": "Specimen", "location": "Location", "derivedFrom": "Observation", "hasMember": "Observation"}
#: Choice elements: the bare name stands for its variants.
CHOICES = {"performed": ("performedDateTime", "performedPeriod"), "effective": ("effectiveDateTime", "effectivePeriod"), "medication": ("medicationReference", "medicationCodeableConcept")}
#: Elements whose earliest value is a resource's event time; Condition takes its encounter's.
EVENT_TIMES = {
    "Observation": ("effectiveDateTime",), "MedicationAdministration": ("effectiveDateTime", "effectivePeriod.start"), "MedicationRequest": ("authoredOn",),
    "Procedure": ("performedDateTime", "performedPeriod.start"), "Encounter": ("period.start", "period.end"), "Condition": (),
}
#: The identifier and code systems, and display names, that the templates ask for.
ICU = "http://fhir.mimic.mit.edu/identifier/encounter-icu"
ORGANISM = "http://mimic.mit.edu/fhir/mimic/CodeSystem/mimic-microbiology-organism"
MICRO_TEST = "http://fhir.mimic.mit.edu/CodeSystem/microbiology-test"
WEIGHTS = ("Daily Weight", "Admission Weight (lbs.)", "Admission Weight (Kg)")

QA_RECORD = from_ddl(
    "patient_id string, patient_id_hash string, question string, query string, now string, perspective string, question_template_id string, question_template string, split string, answer string, "
    "s_placeholders map<string,string>, op_placeholders map<string,string>, t_placeholders map<string,string>, id string, index long, holdout int"
)


def element(schema: StructType | ArrayType, name: str):
    """The type of a struct's field, or None."""
    return schema[name].dataType if isinstance(schema, StructType) and name in schema.names else None
