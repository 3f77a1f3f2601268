
from . import building, guidance, maps, network, registry, reports, trips  # noqa: F401  each module registers its queries
