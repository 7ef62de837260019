"""Label specification, score slots, answer vocabularies and prompt texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Column names, category names, question texts and code tables below are data that
# results depend on; they are stated as they are.

BINARY_LABELS = [
    "DepressedMood",
    "MentalIllnessTreatmentCurrnt",
    "HistoryMentalIllnessTreatmnt",
    "SuicideAttemptHistory",
    "SuicideThoughtHistory",
    "SubstanceAbuseProblem",
    "MentalHealthProblem",
    "DiagnosisAnxiety",
    "DiagnosisDepressionDysthymia",
    "DiagnosisBipolar",
    "DiagnosisAdhd",
    "IntimatePartnerProblem",
    "FamilyRelationship",
    "Argument",
    "SchoolProblem",
    "RecentCriminalLegalProblem",
    "SuicideNote",
    "SuicideIntentDisclosed",
    "DisclosedToIntimatePartner",
    "DisclosedToOtherFamilyMember",
    "DisclosedToFriend",
]
CATEGORICAL_LABELS = {"InjuryLocationType": 6, "WeaponType1": 12}

YES_NO_CODES = {
    "no": 0,
    "yes": 1,
    "no information given": 0,
    "not specified": 0,
    "n/a": 0,
}

LOCATION_NAMES = {
    1: "House, apartment",
    2: "Motor vehicle (excluding school bus and public transportation)",
    3: "Natural area (e.g., field, river, beaches, woods)",
    4: "Park, playground, public use area",
    5: "Street/road, sidewalk, alley",
    6: "Other",
}
WEAPON_NAMES = {
    1: "Blunt instrument",
    2: "Drowning",
    3: "Fall",
    4: "Fire or burns",
    5: "Firearm",
    6: "Hanging, strangulation, suffocation",
    7: "Motor vehicle including buses, motorcycles",
    8: "Other transport vehicle, eg, trains, planes, boats",
    9: "Poisoning",
    10: "Sharp instrument",
    11: "Other (e.g. taser, electrocution, nail gun",
    12: "Unknown",
}

LOCATION_CODES = {
    "house, apartment": 1,
    "motor vehicle (excluding school bus and public transportation)": 2,
    "natural area (e.g., field, river, beaches, woods)": 3,
    "park, playground, public use area": 4,
    "street/road, sidewalk, alley": 5,
    "other": 6,
    "residence": 1,
    "apartment": 1,
    "house": 1,
    "house, apartment (v": 1,
    "house, apartment (for": 1,
    "natural area": 3,
    "field": 3,
    "river": 3,
    "beach": 3,
    "beaches": 3,
    "woods": 3,
    "park": 4,
    "playground": 4,
    "public use area": 4,
    "street/road": 5,
    "sidewalk": 5,
    "alley": 5,
    "driveway": 5,
    "alleyway": 5,
    "barn": 6,
    "bridge": 6,
    "church": 6,
    "dorm": 1,
    "hospital": 6,
    "jail cell": 6,
    "jail": 6,
    "prison cell": 6,
    "prison": 6,
    "school": 6,
    "treatment facility": 6,
    "unspecified": 6,
    "no information": 6,
    "no": 6,
    "dorm room": 6,
    "garage": 1,
    "indoor shooting range": 1,
    "mall": 6,
    "other (in-patient addiction facility)": 6,
    "parking lot": 6,
    "unknown": 6,
}

WEAPON_CODES = {
    "blunt instrument": 1,
    "drowning": 2,
    "fall": 3,
    "fire or burns": 4,
    "firearm": 5,
    "hanging, strangulation, suffocation": 6,
    "motor vehicle including buses, motorcycles": 7,
    "other transport vehicle, eg, trains, planes, boats": 8,
    "poisoning": 9,
    "sharp instrument": 10,
    "other (e.g. taser, electrocution, nail gun)": 11,
    "unknown": 12,
    "carbon monoxide": 9,
    "carbon monoxide, fentanyl, despropionyl f": 9,
    "carbon monoxide inhalation": 9,
    "carbon monoxide intoxication": 9,
    "carbon monoxide poisoning": 9,
    "carbon monoxide toxicity and hyperthermia": 9,
    "carbon monoxide toxicity": 9,
    "firearm (for": 5,
    "other transport vehicle, eg, trains, planes, boats (not specified)": 8,
    "other transport vehicle, eg, trains, planes, boats, motor vehicle including bus": 8,
    "other transport vehicle, eg, trains, planes, boats (not applicable)": 8,
    "other transport vehicle, eg, trains, planes, boats, motorcycles (": 8,
    "other transport vehicle, eg, trains, planes, boats (crossbow)": 8,
    "hanging- brown leather belt - around v's beck - suicide": 6,
    ".380 caliber handgun": 5,
    ".410 break over single shot shotgun": 5,
    ".410 combination rifle": 5,
    ".45 caliber semi-automatic handgun": 5,
    "12 gauge shotgun (incorrect, but the answer provided is": 5,
    "12 gauge shotgun": 5,
    "40-caliber handgun": 5,
    "airplane": 8,
    "alcohol": 9,
    "asphyxia": 6,
    "blunt force injuries": 11,
    "blunt trauma of head, torso and extremities": 11,
    "bupropion and buspirone": 9,
    "bupropion": 9,
    "difluoroethane and diphenhydramine": 9,
    "diphenhydramine": 9,
    "drug toxicity": 9,
    "extreme blunt force traumatic injuries": 3,
    "gsw (gunshot wound)": 5,
    "gsw of the head": 5,
    "gsw to the head": 5,
    "gsw": 5,
    "hanging-strangulation-suffocation": 6,
    "intravenous drug paraphernalia": 9,
    "ligature hanging": 6,
    "ligature": 6,
    "medication overdose": 9,
    "mixed drug (fentanyl, sertraline, and am": 9,
    "mixed drug toxicity": 9,
    "mixed prescription medication": 9,
    "multiple blunt force injuries": 11,
    "multiple blunt impact injury - suicide": 11,
    "multiple blunt force traumatic injuries": 1,
    "no weapon used. the person intentionally jumped from a 2nd story window": 3,
    "none (the person walked in front of oncoming traffic)": 7,
    "other (e.g. gasoline, self-immolation)": 4,
    "other": 11,
    "overdose of recently prescribed citalopram.": 9,
    "pills": 9,
    "plastic bag over the head": 6,
    "plastic bag": 6,
    "polysubstance drug toxicity": 9,
    "prescription medications": 9,
    "quetiapine": 11,
    "revolver": 5,
    "rifle": 5,
    "running motor vehicles in a closed garage": 6,
    "rx overdose": 9,
    "shotgun": 5,
    "sleep aid": 9,
    "suffocation": 9,
    "train": 11,
    "venlafaxine hcl pills": 9,
    "nan": 11,
    "no weapon specified, but journal indicates contemplation of suicide by shooting and jumping off": 2,
    "no weapon used (death by overdose)": 8,
    "no weapon used": 11,
    "no weapon used, the person fell unconscious and not breathing.": 9,
    "no": 11,
    "asphyxiation": 6,
    "blunt impact injuries of head, torso and extremities": 11,
    "combined drug toxicity": 9,
    "crossbow": 10,
    "firearm (revolver)": 5,
    "firearm (v": 5,
    "medication": 9,
    "nitrous oxide": 11,
    "no weapon used.": 3,
    "not applicable (drug overdose)": 9,
    "not applicable (vehicle crash)": 7,
    "not applicable (drug intoxication)": 9,
    "not applicable": 12,
    "other (e.g. methamphetamine)": 11,
    "other (e.g. diphenhydramine pills)": 11,
    "other transport vehicle, eg, trains, planes, boats (carbon monox": 8,
    "over the counter sleeping pills": 11,
    "overdose": 9,
    "paperclips": 11,
    "quetiapine (prescription medication)": 11,
    "sharp instrument (v": 2,
    "no weapon found": 11,
    "no weapon specified": 11,
    "no weapon specified, but journal mentions guns and jumping off a cliff.": 2,
    "no weapon used, but the cause of death is tramadol intoxication": 9,
    "no weapon used, but the cause of death was adverse effects of drug combination": 11,
    "no weapon used, but there were baggies with what appears to be crystal": 11,
}

# Answers that cannot be parsed get these placeholder texts; codes that cannot be
# looked up get these defaults.
UNPARSED_LOCATION = "House, apartment"
UNPARSED_WEAPON = "Firearm"
DEFAULT_LOCATION = 6
DEFAULT_WEAPON = 11

QUESTIONS = [
    "The person was perceived to be depressed at the time",
    "Currently in treatment for a mental health or substance abuse problem",
    "History of ever being treated for a mental health or substance abuse problem",
    "History of attempting suicide previously",
    "History of suicidal thoughts or plans",
    "The person struggled with a substance abuse problem",
    "The person had a mental health condition at the time",
    "Diagnosis Anxiety",
    "Diagnosis Depression or dysthymia",
    "Diagnosis Bipolar",
    "Diagnosis ADHD",
    "Problems with a current or former intimate partner appear to have contributed",
    "Relationship problems with a family member (other than an intimate partner) appear to have contributed",
    "An argument or conflict appears to have contributed",
    "Problems at or related to school appear to have contributed",
    "Criminal legal problem(s) appear to have contributed",
    "The person left a suicide note",
    "The person disclosed their thoughts and/or plans to die by suicide to someone else within the last month",
    "Intent was disclosed to a previous or current intimate partner",
    "Intent was disclosed to another family member",
    "Intent was disclosed to a friend",
    'The type of place where the suicide took place (choices: ["House, apartment", "Motor vehicle (excluding school bus and public transportation)", "Natural area (e.g., field, river, beaches, woods)", "Street/road, sidewalk, alley", "Park, playground, public use area", "Other"])"',
    'Type of weapon used (choices: ["Firearm", "Hanging, strangulation, suffocation", "Poisoning", "Fall", "Other transport vehicle, eg, trains, planes, boats", "Motor vehicle including buses, motorcycles", "Drowning", "Sharp instrument", "Fire or burns", "Blunt instrument", "Unknown", "Other (e.g. taser, electrocution, nail gun)"])',
]

INSTRUCTION_HEAD = (
    "You are an expert abstractor who reads law enforcement (LE) and coroner/medical examiner (CME) narratives about youth suicide and answers the questions. All questions are in the closed form. To most questions you answer either yes or no. Use example input questions and output answers.\n"
    "\n"
)
INSTRUCTION_TAIL = (
    "\n"
    "\n"
    "Answer yes or no to questions Q1-Q21. For questions Q22 and Q23, answer only from the list of possible values.\n"
    "\n"
    "You must answer all 23 questions correctly in the same order. Do NOT output anything other than the answers. Do not include any explanation or summaries. Do not include any other questions and answers that aren't specified in the list.\n"
)
EXAMPLE_BLOCK = (
    "\n-------------\nEXAMPLE INPUT:\n"
    "Narrative LE (a summary of the information in the law enforcement report):\n%s\n\n"
    "Narrative CME (a summary of the information in the coroner/medical examiner report):\n%s\n\n"
    "EXAMPLE OUTPUT:\n%s\n"
)
RECORD_BLOCK = (
    "\n-------------\nINPUT:\n"
    "Narrative LE (a summary of the information in the law enforcement report):\n%s\n\n"
    "Narrative CME (a summary of the information in the coroner/medical examiner report):\n%s\n\n"
    "OUTPUT:\n"
)

# The column reader's tokens for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class LabelSpec:
    """Names and class counts of the labels, binary ones first."""

    binary: list[str]
    categorical: dict[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.binary, *self.categorical]

    @property
    def n_slots(self) -> int:
        return len(self.binary) + sum(self.categorical.values())

    def slot_ranges(self) -> list[tuple[str, str, int, int]]:
        """``(label, kind, first slot, class count)`` per label, slots from zero."""
        rows = [(name, "binary", i, 1) for i, name in enumerate(self.binary)]
        start = len(self.binary)
        for name, n in self.categorical.items():
            rows.append((name, "categorical", start, n))
            start += n
        return rows

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per label: ``label_idx, label, kind, n_classes, slot_from``."""
        rows = [
            (i, label, kind, 2 if kind == "binary" else n, start)
            for i, (label, kind, start, n) in enumerate(self.slot_ranges())
        ]
        return spark.createDataFrame(
            rows, "label_idx int, label string, kind string, n_classes int, slot_from int"
        )


CODING_SPEC = LabelSpec(BINARY_LABELS, CATEGORICAL_LABELS)


def slot_names(spec_df: DataFrame) -> DataFrame:
    """Output slots ``idx, name``: a binary label is its own slot, a categorical one has a
    slot ``<label>_<i>`` per class, zero-padded to the width of its largest class."""
    width = F.length((F.col("n_classes") - 1).cast("string"))
    classes = F.when(F.col("kind") == "binary", F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("n_classes") - 1)
    )
    name = F.when(F.col("kind") == "binary", F.col("label")).otherwise(
        F.concat("label", F.lit("_"), F.lpad(F.col("class_idx").cast("string"), F.col("width"), F.lit("0")))
    )
    return spec_df.withColumn("width", width).withColumn("class_idx", F.explode(classes)).select(
        (F.col("slot_from") + F.col("class_idx")).alias("idx"), name.alias("name"), "label", "class_idx"
    )


def code_table(spark: SparkSession, codes: dict[str, int]) -> DataFrame:
    """A driver-side dict as a table ``raw, code``; it is as large as the dict."""
    return spark.createDataFrame(list(codes.items()), "raw string, code int")
