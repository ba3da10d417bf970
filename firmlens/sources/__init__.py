from firmlens.sources.sinks import materialize, release, shared_folder, write_csv
from firmlens.sources.stand_in import stand_in_panel
from firmlens.sources.statements import read_statements, source_profile, typed_statements

__all__ = [
    "materialize",
    "read_statements",
    "release",
    "shared_folder",
    "source_profile",
    "stand_in_panel",
    "typed_statements",
    "write_csv",
]
