"""Lexical signals over title, abstract and keywords, and the lists they use."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

# These lists decide which records a signal marks.
ACRONYMS = ("cnn", "rnn", "xai", "emg", "eeg", "eog", "ecg", "imu", "ble", "udp", "tcp", "mqtt", "iot", "iomt", "xr")
ACQUISITION = (
    "wearable", "wearables", "wearable sensor", "wearable sensors", "body-worn", "body worn", "sensor", "sensors", "smart sensor",
    "physiological", "physiological responses", "physiological data", "biometric", "biometric data", "biofeedback", "eeg", "eog",
    "ecg", "emg", "imu", "accelerometer", "gyroscope", "camera", "webcam", "eye tracking", "image processing", "computer vision",
    "pose recognition", "pose estimation", "pose tracking", "posture tracking", "motion tracking", "activity recognition",
    "monitoring", "portable device", "portable devices", "human key points", "joint angles",
)
INTERACTION = (
    "serious game", "serious games", "game-based", "game based", "gameplay", "gaming", "game", "games", "exergame", "exergames",
    "virtual reality", "virtual environment", "vr environment", "immersive", "interactive", "interaction", "behavioral task",
    "behavioral tasks", "training", "exercise therapy", "rehabilitation",
)
STIMULATION = (
    "cognitive stimulation", "physical stimulation", "cognitive and physical stimulation",
    "social, cognitive, and physical stimulation", "physical and cognitive stimulation", "stimulation platform",
    "cognitive activities", "physical activities", "cognitive exercises", "physical exercises", "cognitive training",
    "physical training",
)
ASSISTIVE = (
    "ambient assisted living", "aal framework", "aal platform", "aal system", "assistive robot", "assistive robots",
    "socially assistive robot", "socially assistive robots", "assistive platform", "assistive system", "virtual caregiver",
    "virtual communities", "virtual community",
)
GAME = (
    "serious game", "serious gaming", "exergame", "exergaming", "therapeutic game", "health game", "rehabilitation game", "game-based",
    "game based", "gameplay", "gaming", "video game", "virtual game", "game environment", "game task",
)
HEALTH = (
    "health", "healthcare", "patient", "clinical", "rehabilitation", "rehabilit", "therapy", "therapeutic", "physiotherapy",
    "physical therapy", "diagnos", "cerebral palsy", "sarcopenia", "neurolog", "cognitive impairment", "autism", "stroke", "elderly",
    "older adult", "obesity", "physical activity", "exercise", "fitness", "assistive technology",
)
AI = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "cnn", "rnn", "transformer", "computer vision",
    "pose estimation", "pose recognition", "human activity recognition", "pattern recognition", "emotion recognition",
    "classification model", "predictive model", "explainable artificial intelligence", "explainable ai", "xai",
)
DEVICE = (
    "wearable", "sensor", "body-worn", "body worn", "smart device", "smart object", "emg", "eeg", "eog", "imu", "accelerometer",
    "eye tracking", "eye tracker", "robot", "smartphone", "physiological data",
)
COMMUNICATION = (
    "bluetooth", "ble", "wi-fi", "wifi", "wireless", "udp", "tcp", "mqtt", "network", "cloud", "edge", "connected", "communication",
    "transmission", "transmit",
)
EXPLICIT_IOT = ("internet of things", "internet of medical things", "iot", "iomt")
IMMERSIVE = ("virtual reality", "vr environment", "immersive", "extended reality", "xr", "automated vr")
AAL = (
    "ambient assisted living", "assisted living", "independent living", "elderly", "older adults", "assistive robot",
    "assistive robots", "smart objects", "smart home", "virtual communities", "cognitive stimulation", "physical stimulation",
)
SECONDARY = (
    "systematic review", "systematic literature review", "systematic mapping", "scoping review", "literature review",
    "bibliometric analysis", "bibliometric study", "meta-analysis", "meta analysis", "review article",
)
#: Phrases of a justification that state absence outright, and phrases that state an omission.
BLOCKERS = (
    "does not use", "do not use", "not used", "without artificial intelligence", "without machine learning", "no ai is used",
    "sem inteligencia artificial", "nao utiliza", "nao emprega", "regras fixas", "regras predeterminadas", "regras predefinidas",
    "fixed rules", "predefined rules", "rule-based", "rule based", "threshold", "limiar", "calculo convencional",
    "calculos convencionais", "conventional calculation", "traditional statistics", "estatistica tradicional", "only arithmetic",
    "apenas calculos",
)
OMISSIONS = (
    "does not mention", "do not mention", "no mention", "not mentioned", "nao menciona", "nao mencionam", "nao ha mencao",
    "nao e mencionad", "nao sao mencionad", "does not specify", "not specified", "nao especifica", "nao especificad",
    "does not describe", "nao descreve",
)
AI_TOPIC = r"\b(?:ai|ia)\b|artificial intelligence|inteligencia artificial|machine learning|aprendizado de maquina|neural|redes neurais"
STIMULATE = r"\bstimulat(?:ion|ions|e|es|ed|ing)\b"
STIMULUS_CONTEXT = r"\b(?:cognitive|physical|sedentariness)\b"


@dataclass(frozen=True)
class Lexicons:
    """What a screening profile may exchange."""

    acquisition: tuple = ACQUISITION
    interaction: tuple = INTERACTION
    stimulation: tuple = STIMULATION
    assistive: tuple = ASSISTIVE
    acronyms: tuple = ACRONYMS
    extra: dict = field(default_factory=dict)


def contains_any(text: Column, terms: tuple, acronyms: tuple = ACRONYMS) -> Column:
    """Substrings as they stand; acronyms in any case, but only as words of their own, in the Unicode sense."""
    short = [re.escape(t) for t in terms if t in acronyms]
    out = [text.contains(t) for t in terms if t not in acronyms]
    if short:
        out.append(text.rlike(rf"(?iU)(?<!\w)(?:{'|'.join(short)})(?!\w)"))
    return functools.reduce(lambda a, b: a | b, out, F.lit(False))


def signal_text(title: Column, abstract: Column, keywords: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, abstract, keywords)]))


def calibrated(text: Column, lexicons: Lexicons = Lexicons()) -> dict[str, Column]:
    return {k: contains_any(text, getattr(lexicons, k), lexicons.acronyms) for k in ("acquisition", "interaction", "stimulation", "assistive")}


def legacy(text: Column) -> dict[str, Column]:
    """The eight single-topic predicates, by name."""
    has = {k: contains_any(text, v) for k, v in (("game", GAME), ("health", HEALTH), ("ai", AI), ("explicit_iot", EXPLICIT_IOT), ("aal", AAL), ("secondary", SECONDARY))}
    device, communication = contains_any(text, DEVICE), contains_any(text, COMMUNICATION)
    return has | {"connected": device & communication, "multimodal": contains_any(text, IMMERSIVE) & has["ai"] & (device | communication)}


def omission_cue(evidence: Column, notes: Column) -> Column:
    """Whether a negative AI label rests on metadata that do not mention AI, rather than on its stated absence."""
    fold = lambda c: F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    own, both = fold(evidence), fold(F.concat_ws(" ", F.coalesce(evidence, F.lit("")), F.coalesce(notes, F.lit(""))))
    return ~both.rlike("|".join(BLOCKERS)) & own.rlike(f"(?U){AI_TOPIC}") & own.rlike("|".join(OMISSIONS))


def stimulation_cue(text: Column) -> Column:
    return contains_any(text, STIMULATION) | (text.rlike(f"(?U){STIMULATE}") & text.rlike(f"(?U){STIMULUS_CONTEXT}"))
