"""The dictionaries of the query rewriter.  Order matters: entries are applied
one after the other."""

from __future__ import annotations

# Abbreviations, synonyms and Chinese terms with their expansions, in order of use.
ABBREVIATIONS = [
    ("mi", "myocardial infarction"),
    ("cad", "coronary artery disease"),
    ("hf", "heart failure"),
    ("afib", "atrial fibrillation"),
    ("copd", "chronic obstructive pulmonary disease"),
    ("dm", "diabetes mellitus"),
    ("htn", "hypertension"),
    ("ckd", "chronic kidney disease"),
    ("stroke", "cerebrovascular accident"),
    ("pe", "pulmonary embolism"),
    ("dvt", "deep vein thrombosis"),
    ("gi", "gastrointestinal"),
    ("gu", "genitourinary"),
    ("cns", "central nervous system"),
    ("ans", "autonomic nervous system"),
]
SYNONYMS = [
    ("heart attack", "myocardial infarction"),
    ("high blood pressure", "hypertension"),
    ("low blood pressure", "hypotension"),
    ("high blood sugar", "hyperglycemia"),
    ("low blood sugar", "hypoglycemia"),
    ("kidney failure", "renal failure"),
    ("liver failure", "hepatic failure"),
    ("lung infection", "pneumonia"),
    ("blood cancer", "leukemia"),
    ("bone cancer", "osteosarcoma"),
    ("skin cancer", "melanoma"),
    ("chest pain", "angina"),
    ("shortness of breath", "dyspnea"),
    ("difficulty breathing", "dyspnea"),
    ("headache", "cephalgia"),
    ("dizziness", "vertigo"),
    ("fatigue", "tiredness"),
    ("nausea", "feeling sick"),
    ("vomiting", "emesis"),
    ("diarrhea", "loose stools"),
    ("constipation", "difficulty passing stools"),
]
CHINESE_TERMS = [
    ("心梗", "心肌梗死"),
    ("冠心病", "冠状动脉疾病"),
    ("心衰", "心力衰竭"),
    ("房颤", "心房颤动"),
    ("慢阻肺", "慢性阻塞性肺疾病"),
    ("糖尿病", "糖尿病"),
    ("高血压", "高血压病"),
    ("肾病", "肾脏疾病"),
    ("中风", "脑卒中"),
    ("肺炎", "肺部感染"),
]
