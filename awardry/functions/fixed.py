"""Fixed values that results depend on."""

# Terms of severity, by tier.
CATASTROPHIC = [
    "quadriplegia", "tetraplegia", "paraplegia", "catastrophic", "total disability", "permanent vegetative", "complete loss",
    "severe permanent", "brain death", "locked-in", "locked in",
]
SEVERE = [
    "severe", "permanent", "chronic pain", "total loss", "unable to work", "cannot work", "disability pension", "long-term care", "wheelchair",
    "amputation", "traumatic brain injury", " tbi ", "diffuse axonal", "spinal cord", "irreversible", "degenerative",
]
MODERATE = [
    "moderate", "ongoing", "partial", "reduced capacity", "chronic", "persistent", "limitations", "restricted", "accommodation", "modified duties",
]
MILD = [
    "mild", "minor", "temporary", "resolved", "full recovery", "complete recovery", "returned to work", "no permanent", "soft tissue", "whiplash",
    "mtbi", "mild traumatic", "concussion", "strain", "sprain", "bruising",
]

# Section names in the order in which they are looked for.
SECTIONS = [
    "BRAIN & SKULL", "BRAIN AND SKULL", "HEAD", "CERVICAL SPINE", "THORACIC SPINE", "LUMBAR SPINE", "SPINE", "NECK", "SHOULDER", "ARM", "ARMS",
    "ELBOW", "WRIST", "HAND", "CHEST", "THORAX", "ABDOMEN", "PELVIS", "HIP", "KNEE", "LEG", "LEGS", "ANKLE", "FOOT", "PSYCHOLOGICAL",
    "PSYCHIATRIC", "MULTIPLE INJURIES", "SOFT TISSUE",
]
# Parts of texts that are no section, parts of which a section has one, and sections that have others below them.
NO_SECTION = [
    "CONTRIBUTORILY", "P11:", "P12:", "SPECIAL", "DEFENDANT", "PLAINTIFF", "MOTION", "GENERAL DAMAGES", "PECUNIARY", "NON-PECUNIARY", "DAMAGES", "AWARD", "TOTAL",
]
SECTION_PARTS = [
    "GENERAL", "MISCELLANEOUS", "MOST SEVERE", "FATAL", "BRAIN", "SKULL", "HEAD", "EARS", "HEARING", "EYE", "SIGHT", "TEETH", "CERVICAL", "THORACIC",
    "LUMBAR", "SPINE", "SPINAL", "NECK", "BACK", "WHIPLASH", "SHOULDER", "ARM", "ELBOW", "FOREARM", "WRIST", "HAND", "FINGER", "WHOLE", "COLLAR",
    "CHEST", "THORAX", "ABDOMEN", "PELVIS", "BODY", "BUTTOCK", "THIGH", "INTERNAL", "REPRODUCTIVE", "RIBS", "HIP", "KNEE", "LEG", "ANKLE", "FOOT",
    "TOE", "LOWER", "LOSS", "SKIN", "BURNS", "SCARS", "LACERATIONS", "PARAPLEGIA", "QUADRIPLEGIA", "PSYCHOLOGICAL", "PSYCHIATRIC", "MENTAL",
    "TRAUMATIC", "NEUROSIS", "PAIN", "SUFFERING", "MINOR", "MULTIPLE", "SOFT TISSUE", "PRE-EXISTING", "DISABILITY", "CONDITION", "SEXUAL", "ASSAULT",
    "ABUSE", "GUIDANCE", "CARE", "COMPANIONSHIP", "FATHER", "MOTHER", "PARENT", "SON", "DAUGHTER", "CHILD", "BROTHER", "SISTER", "SIBLING", "SPOUSE",
    "HUSBAND", "WIFE", "GRANDFATHER", "GRANDMOTHER", "GRANDPARENT", "GRANDCHILD",
]
MAIN_SECTIONS = ["HEAD", "BRAIN", "SKULL", "ARMS", "SPINE", "BODY", "LEGS", "SKIN", "FATAL INJURIES", "MOST SEVERE INJURIES", "MISCELLANEOUS"]

# Expressions for injuries in comments, in order; group 1 is the injury.
COMMENT_INJURIES = [
    r"\b(?:suffered?|sustained?|experienced?|diagnosed with)\s+([^.;,]+(?:injury|injuries|fracture|damage|trauma|pain|syndrome|disorder|impairment|loss|tear|rupture|herniation|sprain|strain|contusion|hemorrhage|bleeding|concussion))",
    r"\b(brain (?:damage|injury|trauma|hemorrhage))", r"\b(spinal cord (?:injury|damage))", r"\b(traumatic brain injury|tbi)",
    r"\b(post[- ]traumatic stress|ptsd)", r"\b(complex regional pain syndrome|crps)", r"\b(diffuse axonal injury)", r"\b(herniated (?:disc|disk))",
    r"\b(fractured? \w+)", r"\b(torn \w+)", r"\b(ruptured \w+)", r"\b(\w+ fracture)", r"\b(whiplash)", r"\b(chronic pain)",
    r"\b(paralysis|paraplegia|quadriplegia)", r"\b(amputation)", r"\b(vision loss|blindness|hearing loss)", r"\b(internal (?:injuries|bleeding))",
]
# Expressions and words for reports.
REPORT_INJURIES = [
    r"(?:diagnosed|presents with|history of|suffer[s]? from|sustained)\s+([^.]{10,80}?(?:injury|herniation|tear|fracture|strain|sprain|syndrome))",
    r"([^.]{10,80}?(?:disc|ligament|meniscus|tendon)\s+(?:herniation|tear|strain|rupture))",
]
REPORT_SEQUELAE = [
    r"(?:results in|leading to|causes|symptom[s]?:?)\s+([^.]{5,60})",
    r"(?:pain|limitation|difficulty|unable)\s+(?:with|to)\s+([^.]{5,60})",
    r"([^.]{5,60}?(?:pain|limitation|difficulty|dysfunction|weakness))",
]
REPORT_SEVERE, REPORT_MILD = ["severe", "significant", "major", "profound"], ["mild", "minor", "slight"]

# Words for sides.
LEFT, RIGHT, BOTH = ["left", "lt", "lft", "sinister"], ["right", "rt", "rgt", "dextra"], ["bilateral", "bilat", "b/l", "both"]

# Annual means of the consumer price index of Canada, from 1914, for when no file is given.
CPI_FROM = 1914
CPI = [
    6.01, 6.13, 6.68, 7.88, 8.92, 9.77, 11.36, 9.98, 9.2, 9.2, 9.02, 9.13, 9.2, 9.06, 9.13, 9.22, 9.13, 8.23, 7.45, 7.13, 7.22, 7.25, 7.4, 7.67,
    7.71, 7.65, 7.97, 8.45, 8.84, 9.03, 9.09, 9.15, 9.43, 10.28, 11.75, 12.16, 12.48, 13.8, 14.16, 14.02, 14.11, 14.13, 14.32, 14.8, 15.15, 15.33,
    15.54, 15.7, 15.87, 16.12, 16.43, 16.82, 17.46, 18.08, 18.82, 19.68, 20.33, 20.88, 21.93, 23.57, 26.16, 28.95, 31.13, 33.62, 36.63, 39.98,
    44.03, 49.52, 54.86, 58.08, 60.57, 62.98, 65.62, 68.48, 71.23, 74.78, 78.36, 82.77, 84.0, 85.57, 85.71, 87.55, 88.92, 90.37, 91.27, 92.85,
    95.38, 97.78, 99.99, 102.75, 104.66, 106.98, 109.12, 111.45, 114.09, 114.43, 116.47, 119.86, 121.68, 122.82, 125.16, 126.57, 128.37, 130.42,
    133.38, 135.98, 136.96, 141.61, 151.24, 157.11, 160.85, 163.98,
]
REFERENCE_YEAR = 2025
#: Fixed value: the cap on non-pecuniary damages to which awards are compared.
DAMAGES_CAP = 434_000.0
