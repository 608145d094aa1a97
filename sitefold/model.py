"""Names, codes and key columns of the object catalog."""

from __future__ import annotations

#: Object statuses in order; a status's rank is its place.
STATUSES = ("UNKNOWN", "UPLOAD", "READY", "ERR_UPL", "DELETING", "DELETED", "ERR_DEL")
TO_UPDATE = 7
RANK = {name: i for i, name in enumerate(STATUSES)}

#: Codes of reconciliation actions.
UNKNOWN, DELETED, DELETE, READY, UPDATE, UPLOAD, UPGRADE, ERROR = 0, 1, 2, 10, 11, 20, 21, 30

#: Rights are bits; the right with code 7 covers all others.
READ, WRITE, DELETE_RIGHT = 1, 2, 4

KEY = ("bucket", "name")
SITE_KEY = ("site", "bucket", "name")
