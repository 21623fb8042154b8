"""All queries outside the llm subpackage: importing the modules of lodestone.plans registers them."""

from lodestone.catalog import ORACLE_SQL, QUERIES
from lodestone.plans import entity, media, mend, waves

__all__ = ["ORACLE_SQL", "QUERIES", "entity", "media", "mend", "waves"]
