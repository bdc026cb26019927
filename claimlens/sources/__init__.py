from claimlens.sources.tables import read_table  # noqa: F401
from claimlens.sources.fixtures import claims, diagnoses, procedures  # noqa: F401
