"""Two hand-written patients: pA has one of everything that the templates ask for, pB only a Patient resource."""


def _c(display=None, code=None, system=None):
    return {"coding": [{k: v for k, v in (("display", display), ("code", code), ("system", system)) if v is not None}]}


ICU = "http://fhir.mimic.mit.edu/identifier/encounter-icu"
ORGANISM = "http://mimic.mit.edu/fhir/mimic/CodeSystem/mimic-microbiology-organism"
MICRO = "http://fhir.mimic.mit.edu/CodeSystem/microbiology-test"
_ref = lambda r: {"reference": r}
PA = {
    "resourceType": "Bundle",
    "entry": [
        {"resource": r}
        for r in [
            {"resourceType": "Patient", "id": "pA", "birthDate": "2071-03-01", "gender": "female", "identifier": [{"value": "100"}]},
            {"resourceType": "Encounter", "id": "e1", "period": {"start": "2150-01-10T08:00:00-05:00", "end": "2150-01-12T08:00:00-05:00"}, "class": {"code": "AMB"}, "type": [_c("Direct")], "hospitalization": {"admitSource": _c(code="REF")},
             "location": [{"location": _ref("Location/l1"), "period": {"start": "2150-01-11T00:00:00Z"}}, {"location": _ref("Location/l2"), "period": {"start": "2150-01-10T14:00:00Z"}}]},
            {"resourceType": "Encounter", "id": "e2", "period": {"start": "2150-02-01T00:00:00Z", "end": "2150-02-03T00:00:00Z"}, "class": {"code": "EMER"}, "type": [_c("Urgent")], "hospitalization": {"admitSource": _c(code="ER")}},
            {"resourceType": "Encounter", "id": "e3", "period": {"start": "2150-01-10T20:00:00Z"}, "partOf": _ref("Encounter/e1"), "identifier": [{"system": ICU, "value": "1"}]},
            {"resourceType": "Encounter", "id": "e4", "partOf": _ref("Encounter/e1")},
            {"resourceType": "Location", "id": "l1", "name": "Ward"}, {"resourceType": "Location", "id": "l2", "name": "Unit"},
            {"resourceType": "Condition", "id": "c1", "code": _c("Flu"), "encounter": _ref("Encounter/e1")}, {"resourceType": "Condition", "id": "c2", "code": _c("Cough"), "encounter": _ref("Encounter/e1")},
            {"resourceType": "Condition", "id": "c3", "code": _c("Fall"), "encounter": _ref("Encounter/e2")}, {"resourceType": "Condition", "id": "c4", "code": _c("Lost")},
            {"resourceType": "Observation", "id": "o1", "category": [_c(code="laboratory")], "code": _c("Glucose"), "effectiveDateTime": "2150-01-11T06:00:00Z", "valueQuantity": {"value": 5.5, "unit": "mmol/L"}, "referenceRange": [{"low": {"value": 4}, "high": {"value": 6}}]},
            {"resourceType": "Observation", "id": "o2", "category": [_c(code="laboratory")], "code": _c("Glucose"), "effectiveDateTime": "2150-02-01T06:00:00Z", "valueQuantity": {"value": 9.0, "unit": "mmol/L"}, "referenceRange": [{"low": {"value": 4}, "high": {"value": 6}}]},
            {"resourceType": "Observation", "id": "o3", "code": _c("Pulse"), "effectiveDateTime": "2150-01-11T07:00:00Z", "valueQuantity": {"value": 80}},
            {"resourceType": "Observation", "id": "o4", "code": {"coding": [{"display": "Pulse"}, {"display": "Heart rate"}]}, "effectiveDateTime": "2150-01-12T07:00:00Z", "valueQuantity": {"value": 180}},
            {"resourceType": "Observation", "id": "o5", "code": _c("Daily Weight"), "effectiveDateTime": "2150-01-11T09:00:00Z", "valueQuantity": {"value": 70, "unit": "kg"}},
            {"resourceType": "Observation", "id": "o6", "category": [_c(code="Output")], "code": _c("Urine"), "effectiveDateTime": "2150-01-11T10:00:00Z"}, {"resourceType": "Observation", "id": "o7", "code": _c("Urine"), "effectiveDateTime": "2150-01-11T11:00:00Z"},
            {"resourceType": "Specimen", "id": "s1", "type": _c("Blood", "BLD")},
            {"resourceType": "Observation", "id": "m1", "category": [_c(code="laboratory")], "code": _c("Culture", system=MICRO), "effectiveDateTime": "2150-01-13T00:00:00Z", "specimen": _ref("Specimen/s1"), "hasMember": [_ref("Observation/g1"), _ref("Observation/lost")]},
            {"resourceType": "Observation", "id": "g1", "code": _c("E. coli", system=ORGANISM), "effectiveDateTime": "2150-01-14T00:00:00Z", "derivedFrom": [_ref("Observation/m1")]},
            {"resourceType": "Medication", "id": "d1", "identifier": [{"value": "Aspirin"}]},
            {"resourceType": "MedicationRequest", "id": "r1", "authoredOn": "2150-01-10T10:00:00Z", "medicationReference": _ref("Medication/d1"), "dosageInstruction": [{"route": _c(code="PO"), "doseAndRate": [{"doseQuantity": {"value": 100.0}}]}]},
            {"resourceType": "MedicationRequest", "id": "r2", "authoredOn": "2150-02-01T10:00:00Z", "medicationCodeableConcept": _c(code="Heparin"), "dosageInstruction": [{"route": _c(code="IV")}]},
            {"resourceType": "MedicationRequest", "id": "r3", "authoredOn": "2150-01-20T10:00:00Z", "medicationReference": _ref("Medication/d1")}, {"resourceType": "MedicationRequest", "id": "r4", "medicationReference": _ref("Medication/lost")},
            {"resourceType": "MedicationAdministration", "id": "a1", "effectiveDateTime": "2150-01-11T01:00:00Z", "context": _ref("Encounter/e3"), "medicationCodeableConcept": _c("Saline")},
            {"resourceType": "MedicationAdministration", "id": "a2", "effectivePeriod": {"start": "2150-01-11T02:00:00Z"}, "context": _ref("Encounter/e1"), "medicationCodeableConcept": _c("Saline")},
            {"resourceType": "Procedure", "id": "p1", "code": _c("Biopsy"), "performedDateTime": "2150-01-11T12:00:00Z"}, {"resourceType": "Procedure", "id": "p2", "code": _c("Dialysis"), "performedPeriod": {"start": "2150-02-02T00:00:00Z", "end": "2150-02-02T04:00:00Z"}},
        ]
    ],
}
PB = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "pB", "birthDate": "2080-01-01", "gender": "male"}}]}
#: A value for each slot that pA has
ASK = {
    "drug_name": "Aspirin", "drug_name1": "Nothing", "drug_name2": "Heparin", "drug_name3": "Never", "procedure_name": "Biopsy", "admission_route": "REF", "diagnosis_name": "Flu", "drug_route": "PO", "input_name": "Saline",
    "lab_name": "Glucose", "output_name": "Urine", "spec_name": "BLD", "vital_name": "Pulse", "vital_value": 50.0, "comparison": "greater",
}
