"""The fixed facts of the model space: terms, structural rules, labels, levels."""

from __future__ import annotations

from dataclasses import dataclass

# The eight predictors, in the order that numbers the candidates.
TERMS = (
    "host",
    "source",
    "source:host",
    "genus",
    "genus:source",
    "native",
    "(1|block)",
    "(1|family)",
)

# A term on the left needs every term on the right.
INTERACTION_RULES = (
    ("source:host", ("host", "source")),
    ("genus:source", ("genus", "source")),
)
NESTING_RULES = (
    ("host", ("genus",)),
    ("(1|family)", ("source",)),
)

# Factor label of each term.
FACTOR_LABELS = {
    "(1|family)": "Family (RE)",
    "(1|block)": "Block (RE)",
    "source:host": "Host x Source Interaction",
    "genus:source": "Genus x Source Interaction",
    "genus": "Genus",
    "host": "Host Site",
    "source": "Source Site",
    "native": "Native",
}
JOINT_SOURCE, POOLED_SOURCE = "Source + Family", "Source (pooled)"
JOINT_HOST, POOLED_HOST = "Genus + Host", "Host (pooled)"
RANDOM_TERMS = ("(1|block)", "(1|family)")

# Site codes, display names and their plotting order.
SITE_LABELS = (
    ("lau", "Lawier", 1),
    ("boo", "Boot", 2),
    ("rob", "Roberts", 3),
    ("ech", "Echo", 4),
    ("gos", "Gossling", 5),
)

# Prior scales on the link scale.
INTERCEPT_SD = 6.0
FIXED_SD = {"count": 1.5, "prop": 1.0}
RANDOM_SD = {"count": 1.5, "prop": 1.0}

# Reported quantiles.
EFFECT_PROBS = (0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975)
EFFECT_NAMES = ("q_025", "q_05", "q_25", "q_5", "q_75", "q_95", "q_975")
EV_PROBS = (0.005, 0.025, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.975, 0.995)
EV_NAMES = ("q_005", "q_025", "q_05", "q_1", "q_25", "q_75", "q_9", "q_95", "q_975", "q_995")

NULL_BLOCK = "p100"
ADAPT_DELTA = 0.95


@dataclass(frozen=True)
class Design:
    """Which level of each factor is the reference, which hosts form genus A, and which sources take part (all by default)."""

    host: str = "AFRICA"
    source: str = "AFRICA"
    genus: str = "A"
    genus_a_hosts: tuple[str, ...] = ("AMERICA", "ASIA")
    sources: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Form:
    """A right-hand side with a closed-form fit.

    ``keys`` are the cell columns whose combinations get their own estimate.
    ``parent`` is set for a random intercept: groups are shrunk towards the
    estimate of their parent (an empty tuple means the overall estimate).
    """

    name: str
    terms: tuple[str, ...]
    keys: tuple[str, ...]
    parent: tuple[str, ...] | None = None

    @property
    def random(self) -> bool:
        return self.parent is not None

    @property
    def mask(self) -> int:
        return sum(1 << TERMS.index(t) for t in self.terms)


FIXED_FORMS = (
    Form("source", ("source",), ("source_site",)),
    Form("genus", ("genus",), ("genus",)),
    Form("native", ("native",), ("native",)),
    Form("host", ("host", "genus"), ("host_site",)),
    Form("genus_source", ("source", "genus", "genus:source"), ("genus", "source_site")),
    Form("host_source", ("host", "source", "source:host", "genus"), ("host_site", "source_site")),
)
RANDOM_FORMS = (
    Form("block", ("(1|block)",), ("block",), ()),
    Form("source_family", ("source", "(1|family)"), ("family",), ("source_site",)),
)
FORMS = FIXED_FORMS + RANDOM_FORMS
