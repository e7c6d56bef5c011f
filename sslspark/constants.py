"""Label sentinels and the label vocabulary.

One encoding everywhere: ``label_id >= 0`` labelled, ``OOD`` (-100) for an
out-of-distribution row, ``UNLABELLED`` (-200) for a row without a label.
"""

OOD = -100
UNLABELLED = -200
IGNORE = -1  # label ignored by losses (as in the reference's loss helper)

# ---------------------------------------------------------------------------
# FIXED VALUES: label vocabulary of the reference's biomedical context tasks.
# Class id = position in the list.  These must match the reference exactly.
# ---------------------------------------------------------------------------
CONTEXT_TYPES = ["location", "cell_line", "cell_type", "organ", "disease", "species"]
RELATION = ["Activation", "Inhibition", "IncreaseAmount", "DecreaseAmount", "GtpActivation"]
LOCATION = ["Cytoplasm", "Cell Membrane", "Cell Nucleus", "Extracellular Matrix", "Extracellular Space"]
CELL_LINE = ["HeLa cell", "MCF7 cell", "293 cell", "A549 cell", "NIH-3T3 cell",
             "Hep G2 cell", "U-937 cell", "THP-1 cell", "LNCAP cell", "COS-1 cell"]
CELL_TYPE = ["macrophage", "endothelial cell", "fibroblast", "monocyte", "fat cell",
             "smooth muscle cell", "hepatocyte", "T cell", "cardiac muscle cell", "neuron"]
ORGAN = ["liver", "lung", "skeletal muscle tissue", "endothelium", "cardiovascular system",
         "adipose tissue", "heart", "cardiovascular system endothelium", "blood vessel smooth muscle",
         "aorta"]
DISEASE = ["neuroblastoma", "breast cancer", "lung cancer", "atherosclerosis",
           "multiple myeloma", "leukemia", "melanoma", "osteosarcoma", "non-small cell lung carcinoma"]
SPECIES = ["Homo sapiens", "Mus musculus", "Rattus norvegicus"]
AUG_COLS = ["umls", "sr", "ri", "rs", "rd"]
# Species names as the primary gene service spells them -> allowed species.
SPECIES_FULL_TO_ALLOWED = {
    "Homo sapiens (Human)": "Homo sapiens",
    "Mus musculus (Mouse)": "Mus musculus",
    "Rattus norvegicus (Rat)": "Rattus norvegicus",
}
# ---------------------------------------------------------------------------

TASK_CLASSES = {
    "location": LOCATION,
    "cell_line": CELL_LINE,
    "cell_type": CELL_TYPE,
    "organ": ORGAN,
    "disease": DISEASE,
    "species": SPECIES,
    "relation": RELATION,
}

# Views fed to the weak / strong augmentations (trap T6).
VIEW_PRESETS = {
    "single_task": ("umls", "sr", "ri"),
    "multi_task": ("text", "umls", "umls"),
}
