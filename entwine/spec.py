"""The domain lives here, and only here.

A ``GraphSpec`` names which columns of a wide fact table are entities, which one is
the hub, which metrics each entity type reports, which value distributions it keeps,
and which hub relations become graph edges. Every operator is generic over it.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Attribute:
    """A categorical column of the fact table."""
    key: str            # short name used in output (e.g. "medication")
    column: str         # column in the cleaned fact table
    node_type: str | None = None   # set when the attribute becomes graph nodes
    type_label: str | None = None  # human label used in tooltips
    category: str | None = None    # plural summary key
    metrics: tuple[str, ...] = ()  # metrics reported for this entity type
    dists: tuple[str, ...] = ()    # attribute keys whose distribution is kept


@dataclass(frozen=True)
class Relation:
    """A hub → attribute edge set."""
    name: str
    target: str          # attribute key
    unit: str            # "patients" or "cases"
    top_k: int | None = None   # keep only the k heaviest targets per hub


@dataclass(frozen=True)
class GraphSpec:
    attributes: tuple[Attribute, ...]
    hub: str
    relations: tuple[Relation, ...]
    colors: dict = field(default_factory=dict)
    metric_columns: dict = field(default_factory=dict)   # metric → numeric column
    metric_scale: dict = field(default_factory=dict)     # metric → decimals kept
    emergency_value: str = ""
    update_batch_size: int = 5000
    default_color: str = "#888888"
    default_node_type: str = "unknown"
    default_relationship: str = "CONNECTED_TO"
    total_default: int = 55500

    def attr(self, key: str) -> Attribute:
        for a in self.attributes:
            if a.key == key:
                return a
        raise KeyError(key)

    @property
    def node_attrs(self) -> tuple[Attribute, ...]:
        return tuple(a for a in self.attributes if a.node_type)

    def type_rank(self, node_type: str) -> int:
        return [a.node_type for a in self.node_attrs].index(node_type)

    def pairs(self) -> list[tuple[str, str]]:
        """Unordered attribute pairs whose joint counts serve every distribution
        and every edge: each kept once, ordered by attribute position."""
        order = [a.key for a in self.attributes]
        seen: list[tuple[str, str]] = []
        for a in self.node_attrs:
            for d in a.dists:
                p = tuple(sorted((a.key, d), key=order.index))
                if p not in seen:
                    seen.append(p)
        for r in self.relations:
            p = tuple(sorted((self.hub, r.target), key=order.index))
            if p not in seen:
                seen.append(p)
        return seen


# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's for equal results: node colours,
# tooltip type labels, relation names and units, the top-k of blood types per
# condition (4), the update batch size (5000), the default total (55500), and the
# metrics / distributions each entity type reports.
# ---------------------------------------------------------------------------
NODE_COLORS = {
    "condition": "#D9506A",
    "medication": "#FFC900",
    "insurer": "#00FFBC",
    "admission_type": "#4A9EF5",
    "test_result": "#F07828",
    "blood_type": "#A870DC",
}

HEALTHCARE = GraphSpec(
    attributes=(
        Attribute("condition", "medical_condition", "condition", "Medical Condition", "conditions",
                  ("age", "billing", "stay"),
                  ("medication", "insurer", "admission", "result", "blood_type", "gender")),
        Attribute("medication", "medication", "medication", "Medication", "medications",
                  ("billing",), ("condition", "insurer", "admission", "result")),
        Attribute("insurer", "insurance_provider", "insurer", "Insurance Provider", "insurers",
                  ("billing", "age"), ("condition", "medication", "admission", "result")),
        Attribute("admission", "admission_type", "admission_type", "Admission Type", "admission_types",
                  ("billing", "stay"), ("condition",)),
        Attribute("result", "test_results", "test_result", "Test Result", "test_results",
                  ("billing",), ("condition",)),
        Attribute("blood_type", "blood_type", "blood_type", "Blood Type", "blood_types",
                  ("age", "billing"), ("condition",)),
        Attribute("gender", "gender"),
    ),
    hub="condition",
    relations=(
        Relation("TREATED_WITH", "medication", "patients"),
        Relation("COVERED_BY", "insurer", "patients"),
        Relation("ADMITTED_AS", "admission", "cases"),
        Relation("SHOWS_RESULT", "result", "cases"),
        Relation("ASSOCIATED_WITH", "blood_type", "patients", top_k=4),
    ),
    colors=NODE_COLORS,
    metric_columns={"age": "age", "billing": "billing_amount", "stay": "length_of_stay"},
    metric_scale={"age": 1, "billing": 2, "stay": 1},
    emergency_value="1-URGENT",
    update_batch_size=5000,
)

# Stand-in mapping from the driver's star schema to the fact table's columns.
VISIT_COLUMNS = {
    "name": "c_name",
    "age": "l_quantity",
    "gender": "l_linestatus",
    "blood_type": "p_brand",
    "medical_condition": "p_type",
    "medication": "c_mktsegment",
    "insurance_provider": "r_name",
    "admission_type": "o_orderpriority",
    "test_results": "l_returnflag",
    "date_of_admission": "o_orderdate",
    "discharge_date": "l_shipdate",
    "billing_amount": "l_extendedprice",
    "doctor": "p_name",
}
