"""Labels, relationship types and rule sets of the graph model."""

# The closed sets of the data model, in its order.
NODE_LABELS = tuple("Project Package Module Folder File Class Function Method Variable Interface Enum Decorator Import Type CodeElement Community Process Struct Macro Typedef Union Namespace Trait Impl TypeAlias Const Static Property Record Delegate Annotation Constructor Template Section Route Tool Library Controller ControllerAction ApiEndpoint View ViewModel DbEntity DbContext Area Filter WebConfig PartialView ScriptFile AjaxCall UiComponent Service Repository ExternalService Document DocChunk TodoMarker DbColumn EnvVar".split())
EDGE_TYPES = tuple("CONTAINS CALLS INHERITS OVERRIDES IMPORTS USES DEFINES DECORATES IMPLEMENTS EXTENDS HAS_METHOD HAS_PROPERTY ACCESSES MEMBER_OF STEP_IN_PROCESS HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF WRAPS RENDERS_VIEW BELONGS_TO_AREA MAPS_TO_ENTITY HAS_ACTION BINDS_MODEL ASSOCIATES_WITH HAS_FILTER USES_PARTIAL CONFIGURED_BY CALLS_ACTION INCLUDES_SCRIPT RENDERS_COMPONENT DEPENDS_ON CALLS_SERVICE BELONGS_TO MENTIONS HAS_COLUMN REFERENCES_TABLE USES_ENV_VAR REPRESENTED_BY HANDLED_BY".split())
#: Relationship types of the test tables' own graph, known beside the closed set.
STAR_TYPES = ("IN_REGION", "IN_NATION", "PLACED", "CONTAINS_PART", "SUPPLIES")
CALLABLE = ("Method", "Function", "Constructor")
FTS_LABELS = ("Function", "Class", "Method", "Interface", "File", "Struct", "Trait", "Enum", "Variable", "Type", "Module", "Route", "Tool", "Controller", "ControllerAction", "View", "ScriptFile", "UiComponent", "Service", "Repository", "ExternalService")
COMMUNITY_LABELS = ("Function", "Method", "Class", "Interface", "Struct", "Trait", "Enum", "Constructor")
COMMUNITY_EDGES = ("CALLS", "EXTENDS", "IMPLEMENTS", "IMPORTS")
IMPACT_SKIPPED = ("CONTAINS", "STEP_IN_PROCESS", "DEFINES", "MEMBER_OF", "BELONGS_TO_AREA")
CHANGE_EDGES = ("CALLS", "CALLS_ACTION", "CALLS_SERVICE", "IMPORTS", "USES", "DEPENDS_ON", "INHERITS", "IMPLEMENTS", "EXTENDS", "OVERRIDES", "RENDERS_VIEW", "HANDLES_ROUTE", "FETCHES", "MAPS_TO_ENTITY")
BUSINESS_LABELS = ("Class", "Method", "Function", "Constructor", "Interface", "Controller", "ControllerAction", "Service", "Repository", "Route")
NOISY_LABELS = ("ScriptFile", "Import", "ExternalService", "UiComponent")
