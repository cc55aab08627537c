"""Record types of a catalog, its enumerations and tags."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerloom.functions.paths import STATE_DIR

# Enumerations and path markers.
PERSPECTIVES = ("product", "technical")
AUDIENCES = ("user", "admin", "developer", "operator")
STATUSES = ("generated", "partial", "pending")
PHASES = ("user_action", "frontend", "request", "backend", "persistence", "external", "response", "ui_update")
FRONTEND_MARKERS = ("frontend/", "/app/", "/pages/", "/components/")
BACKEND_MARKERS = ("backend/", "/backend/", "server/", "/server/", "/routes/")
ID_PATTERN = r"^[a-z0-9][a-z0-9_]{0,63}\z"

EVIDENCE = "struct<file:string,symbol:string,line:int,code_start:int,code_end:int>"
OPTION = f"struct<phase:string,title:string,text:string,evidence:array<{EVIDENCE}>>"
STEP = f"struct<number:int,phase:string,title:string,text:string,evidence:array<{EVIDENCE}>,options:array<{OPTION}>>"
AREA = "struct<id:string,title:string,summary:string,perspective:string,`order`:int>"
FEATURE = "struct<id:string,area_id:string,title:string,audience:string,summary:string,workflow_path:string>"
#: Members of lists stay JSON text, so that their exact form can be compared.
INDEX = "struct<schema:string,source_hash:string,generator:string,areas:array<string>,features:array<string>>"
WORKFLOW = (
    "struct<schema:string,source_hash:string,generator:string,feature_id:string,title:string,summary:string,"
    f"status:string,missing_coverage:string,evidence:array<{EVIDENCE}>,steps:array<{STEP}>>"
)


@dataclass(frozen=True)
class Tags:
    """Schema and generator tags that documents must carry."""

    index_schema: str = "catalog/features@4"
    workflow_schema: str = "catalog/feature-workflow@4"
    index_generator: str = "catalog-index@4"
    workflow_generator: str = "catalog-workflow@4"
    state_dir: str = STATE_DIR

    def workflow_path(self, feature_id: str) -> str:
        return f"{self.state_dir}/workflows/{feature_id}.yaml"
