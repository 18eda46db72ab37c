"""Where jobs leave intermediate tables: the folder that the cluster names in ``spark.checkpoint.dir``."""

from starframe.functions.shared import cut, folder

__all__ = ["cut", "folder"]
