"""Attack labels and ATT&CK stages as column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Stage id, name, tactic id, tactic.
STAGES = [
    (0, "BENIGN", None, "No adversary activity"),
    (1, "RECONNAISSANCE", "TA0043", "Reconnaissance"),
    (2, "INITIAL_ACCESS", "TA0001", "Initial Access"),
    (3, "LATERAL_MOVEMENT", "TA0008", "Lateral Movement"),
    (4, "COMMAND_AND_CONTROL", "TA0011", "Command and Control"),
    (5, "EXFILTRATION", "TA0010", "Exfiltration"),
    (6, "IMPACT", "TA0040", "Impact"),
]

# Labels that mean "no attack".
BENIGN_LABELS = ["benign", "normal", "background", "0", ""]

# Ordered substring rules, the first hit decides.
LABEL_RULES = [
    ("portscan", 1), ("reconnaissance", 1), ("analysis", 1), ("recon-", 1),
    ("vulnerabilityscan", 1), ("scan", 1),
    ("heartbleed", 5), ("exfil", 5),
    ("infilt", 3), ("worm", 3),
    ("botnet", 4), ("bot", 4), ("backdoor", 4), ("mirai", 4),
    ("ddos", 6), ("dos", 6),
    ("patator", 2), ("brute", 2), ("web attack", 2), ("sql", 2), ("xss", 2),
    ("injection", 2), ("exploit", 2), ("shellcode", 2), ("fuzzer", 2), ("generic", 2),
    ("spoof", 2), ("mitm", 2), ("hijack", 2), ("upload", 2),
]
FALLBACK_STAGE = 2


def load_label_rules(path: str) -> dict:
    """Rules from a YAML mapping (`benign_labels`, ordered `rules`, `default_attack_stage`)."""
    import yaml

    with open(path, encoding="utf-8") as fh:
        doc = yaml.safe_load(fh)
    return {"rules": [(r["match"], int(r["stage"])) for r in doc["rules"]],
            "benign": [str(b) for b in doc["benign_labels"]],
            "fallback": int(doc["default_attack_stage"])}


def stage_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage int, stage_name string, tactic_id string, tactic string")


def stage_field(stage: Column, position: int) -> Column:
    """Look one attribute of the seven-row dimension up without a join."""
    return F.element_at(F.array(*[F.lit(s[position]).cast("string") for s in STAGES]),
                        stage.cast("int") + 1)


def stage_name(stage: Column) -> Column:
    return stage_field(stage, 1)


def tactic_id(stage: Column) -> Column:
    return stage_field(stage, 2)


def tactic(stage: Column) -> Column:
    return stage_field(stage, 3)


def _norm(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def is_benign(label: Column, benign: Sequence[str] = BENIGN_LABELS) -> Column:
    s = _norm(label)
    return F.when(s.startswith("flow="), ~s.contains("botnet")).otherwise(s.isin(*benign))


def label_to_stage(label: Column, rules: Sequence[tuple[str, int]] = LABEL_RULES,
                   benign: Sequence[str] = BENIGN_LABELS, fallback: int = FALLBACK_STAGE) -> Column:
    """Stage of a raw label: benign, else the first rule contained in it, else the fallback.

    The rules are one constant array; the normalised label is bound once per row.
    """
    table = F.expr("array(" + ", ".join(
        "named_struct('text', '{}', 'stage', {})".format(m.replace("'", "\\'"), s) for m, s in rules) + ")")

    def stage_of(s: Column) -> Column:
        quiet = F.when(s.startswith("flow="), ~s.contains("botnet")).otherwise(s.isin(*benign))
        hits = F.filter(table, lambda r: s.contains(r["text"]))
        return F.when(quiet, F.lit(0)).otherwise(F.coalesce(F.get(hits, F.lit(0))["stage"], F.lit(fallback)))

    return F.transform(F.array(_norm(label)), stage_of)[0].cast("int")


def map_stage(risk: Column, probs: Column, threshold: float | Column, gate: float = 0.5) -> Column:
    """0 below the gate, else the likeliest attack stage; the first of equals wins."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    attack = F.slice(probs, 2, 6)
    return F.when(risk < thr * gate, F.lit(0)).otherwise(
        F.array_position(attack, F.array_max(attack)).cast("int")).cast("int")
