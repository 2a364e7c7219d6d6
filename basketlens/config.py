"""Every named threshold of the engine, in one frozen record.

The defaults are fixed values: the published bars, drawn for populations of some
forty baskets. Each dataset re-draws them by replacing fields, never by editing an
operator.
"""

from dataclasses import dataclass, replace

LEAGUE = "league"
CHALLENGE = "challenge-class"


@dataclass(frozen=True)
class EngineConfig:
    # Cohort rule: every signature item is held; segments are bands of copies of
    # the divergence item, given as (name, fewest, most); the rest are hybrids.
    cohort: str = "cohort"
    signature: tuple[str, ...] = ()
    watch_item: str = ""
    divergence_item: str = ""
    segments: tuple[tuple[str, int, int], ...] = ()
    hybrid_segment: str = "hybrid"
    # Which quantities decide membership: board "a" alone, or "either" board.
    membership_board: str = "a"
    item_aliases: tuple[tuple[str, str], ...] = ()
    share_aliases: tuple[tuple[str, str], ...] = ()
    typed_label: str = "LAND"

    # Time. Dates are ISO text; window lengths are days.
    history_start: str = "2026-02-01"
    epoch_start: str = "2026-05-18"
    fresh_days: int = 14
    baseline_days: int = 28
    unsettled_days: int = 3
    deadline: str = "2026-08-27"

    # Share snapshots.
    share_cohort: str = ""
    share_window_days: int = 14

    cap_collapse: float = 0.5

    # Hype episodes.
    hype_window_days: int = 14
    hype_floor: float = 0.10
    hype_ceiling: float = 0.30
    hype_min_lists: int = 8
    hype_origin_placement: int = 16

    # Fringe items.
    fringe_adoption: float = 0.10
    return_absence_days: int = 28

    # Pet items and proven actors.
    pet_appearances: int = 3
    pet_actors: int = 2
    proven_finishes: int = 2
    proven_placement: int = 16

    # Departures and their follow-through.
    departure_delta: int = 5
    departure_placement: int = 16
    departure_ceiling: int = 12
    departure_min_lists: int = 8
    trendsetter_followers: int = 2
    trendsetter_share: float = 0.05
    trendsetter_days: int = 14

    # Board migration.
    migration_min_lists: int = 8
    board_shift: float = 0.15

    # Reference audit.
    core_adoption: float = 0.90
    consensus_adoption: float = 0.50
    supported_minority: float = 0.10
    pair_support: float = 0.10
    boundary_lists: int = 2
    unplayed_floor: float = 0.25
    unplayed_limit: int = 10
    tilt_floor: float = 0.05

    # Outcome contrast.
    alpha: float = 0.05
    power_z: float = 2.8

    # Weekly averages: a list is panel one on at most `split_max` copies of the
    # split item and a count of the other item in `other_range`, panel two on a
    # count of the split item in `split_range`.
    panel_names: tuple[str, str] = ("one", "two")
    panel_split_item: str = ""
    panel_other_item: str = ""
    panel_split_max: int = 1
    panel_other_range: tuple[int, int] = (3, 4)
    panel_split_range: tuple[int, int] = (2, 4)
    mover_threshold: float = 1.0

    named_arrivals: int = 20
    substitution_ends: int = 8

    @property
    def segment_names(self) -> tuple[str, ...]:
        """The named segments, which are the ones a consensus is read over."""
        return tuple(name for name, _, _ in self.segments)


# The published rules of the decklist domain. They are data the
# results depend on, and a reading over real payloads needs exactly these.
DECKLISTS = EngineConfig(
    cohort="goryos",
    signature=(
        "Goryo's Vengeance",
        "Atraxa, Grand Unifier",
        "Psychic Frog",
        "Ephemerate",
    ),
    watch_item="Goryo's Vengeance",
    divergence_item="Fallaji Archaeologist",
    segments=(("fallaji", 3, 4), ("non-fallaji", 0, 0)),
    item_aliases=(("Superior Spider-Man", "Kavaero, Mind-Bitten"),),
    share_aliases=(
        ("Eldrazi", "Broodscale"),
        ("Gruul Basking Broodscale Combo", "Broodscale"),
    ),
    share_cohort="Goryo's Vengeance",
    panel_names=("Riddler Goryo's", "Fallaji Goryo's"),
    panel_split_item="Fallaji Archaeologist",
    panel_other_item="Quantum Riddler",
)

# The star-schema mapping: an order is a basket and its parts' types and brands
# are the items. Bars are re-drawn because a vocabulary of 31 items shares out
# very differently from a card pool.
STAR = replace(
    EngineConfig(),
    cohort="staples",
    signature=("type:ECONOMY", "type:STANDARD"),
    watch_item="type:ECONOMY",
    divergence_item="type:PROMO",
    segments=(("with", 2, 1_000_000), ("without", 0, 0)),
    membership_board="either",
    share_aliases=(("error", "click"),),
    typed_label="STANDARD",
    history_start="1995-01-01",
    epoch_start="1996-01-01",
    fresh_days=180,
    baseline_days=360,
    deadline="2001-08-15",
    share_cohort="view",
    share_window_days=7,
    hype_window_days=28,
    fringe_adoption=0.19,
    pet_appearances=2,
    supported_minority=0.18,
    core_adoption=0.50,
    consensus_adoption=0.30,
    departure_delta=4,
    trendsetter_days=28,
    panel_names=("plain", "promoted"),
    panel_split_item="type:PROMO",
    panel_other_item="type:STANDARD",
    panel_split_max=0,
    panel_other_range=(1, 9),
    panel_split_range=(1, 9),
    mover_threshold=2.0,
)
