"""A small dictionary of biomedical terms, for use where no larger one is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Terms and the ids of their descriptors.
SEED_TERMS = {
    "cancer": "D009369", "diabetes": "D003920", "hypertension": "D006973", "asthma": "D001249", "obesity": "D009765", "stroke": "D020521",
    "alzheimer": "D000544", "parkinson": "D010300", "epilepsy": "D004827", "tuberculosis": "D014376", "malaria": "D008288", "hepatitis": "D006505",
    "pneumonia": "D011014", "sepsis": "D018805", "anemia": "D000740", "leukemia": "D007938", "lymphoma": "D008223", "melanoma": "D008545",
    "carcinoma": "D002277", "sarcoma": "D012509", "glioma": "D005910", "fibrosis": "D005355", "cirrhosis": "D008103", "arthritis": "D001168",
    "osteoporosis": "D010024", "atherosclerosis": "D050197", "myocardial infarction": "D009203", "heart failure": "D006333",
    "chronic kidney disease": "D051436", "copd": "D029424", "covid-19": "D000086382", "sars-cov-2": "D000086402", "influenza": "D007251",
    "hiv": "D015658", "aids": "D000163", "depression": "D003863", "schizophrenia": "D012559", "anxiety": "D001007", "dementia": "D003704",
    "migraine": "D008881", "psoriasis": "D011565", "eczema": "D004485", "lupus": "D008180", "crohn": "D003424", "ulcerative colitis": "D003093",
    "celiac disease": "D002446", "multiple sclerosis": "D009103", "amyotrophic lateral sclerosis": "D000690", "metformin": "D008687",
    "insulin": "D007328", "aspirin": "D001241", "ibuprofen": "D007052", "paracetamol": "D000082", "acetaminophen": "D000082", "penicillin": "D010406",
    "amoxicillin": "D000658", "ciprofloxacin": "D002939", "doxycycline": "D004318", "methotrexate": "D008727", "cisplatin": "D002945",
    "doxorubicin": "D004317", "tamoxifen": "D013629", "warfarin": "D014859", "heparin": "D006493", "statin": "D019161", "atorvastatin": "D000069059",
    "omeprazole": "D009853", "prednisone": "D011241", "chemotherapy": "D004358", "immunotherapy": "D007167", "radiotherapy": "D011878",
    "antibiotics": "D000900", "p53": "D016159", "brca1": "D019398", "brca2": "D024682", "egfr": "D011958", "vegf": "D042461", "tnf": "D014409",
    "interleukin": "D007378", "interferon": "D007372", "hemoglobin": "D006454", "albumin": "D000418", "cytokine": "D016207", "antibody": "D000906",
    "antigen": "D000941", "receptor": "D011956", "kinase": "D010770", "protease": "D010447", "collagen": "D003094", "fibronectin": "D005353",
    "liver": "D008099", "kidney": "D007668", "lung": "D008168", "brain": "D001921", "heart": "D006321", "pancreas": "D010179", "colon": "D003106",
    "stomach": "D013270", "breast": "D001940", "prostate": "D011467", "ovary": "D010053", "thyroid": "D013961", "spleen": "D013154",
    "bone marrow": "D001853", "pcr": "D016133", "elisa": "D004797", "western blot": "D015153", "flow cytometry": "D005434",
    "mass spectrometry": "D013058", "chromatography": "D002845", "sequencing": "D012150", "biopsy": "D001706", "mri": "D008279", "ct scan": "D014057",
    "ultrasound": "D014463", "microscopy": "D008853", "mortality": "D009026", "survival": "D016019", "prognosis": "D011379", "diagnosis": "D003933",
    "biomarker": "D015415", "screening": "D008403", "prevalence": "D015995", "incidence": "D015994", "randomized controlled trial": "D016449",
    "meta-analysis": "D015201", "cohort study": "D015331", "case-control": "D016022", "placebo": "D010919", "double-blind": "D004311",
    "dna": "D004247", "rna": "D012313", "mrna": "D012333", "protein": "D011506", "gene expression": "D015870", "mutation": "D009154",
    "polymorphism": "D011110", "methylation": "D019175", "phosphorylation": "D010766", "apoptosis": "D017209", "autophagy": "D001343",
    "inflammation": "D007249", "oxidative stress": "D018384", "angiogenesis": "D018919", "metastasis": "D009362", "cell proliferation": "D049109",
    "cell differentiation": "D002454", "stem cells": "D013234", "t cells": "D013601", "b cells": "D001402", "macrophage": "D008264",
    "neutrophil": "D009504", "platelet": "D001792", "erythrocyte": "D004912", "mitochondria": "D008928", "endoplasmic reticulum": "D004721",
    "ribosome": "D012270", "chromosome": "D002875", "genome": "D016678", "proteome": "D020543", "metabolome": "D055442", "microbiome": "D064307",
    "epigenetics": "D057890", "crispr": "D000071837", "sirna": "D034741",
}


def seed_terms(spark: SparkSession) -> DataFrame:
    """(term, concept_id) of the fixed dictionary."""
    return spark.createDataFrame(list(SEED_TERMS.items()), "term string, concept_id string")
