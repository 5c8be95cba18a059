"""Rule tables of the four rule engines.

Conditions are SQL over the columns ``path``, ``content`` and the counts ``c_*``;
they hold in Spark SQL and in standard SQL alike, so the tables serve any engine.
"""

from __future__ import annotations

from typing import NamedTuple

# Path predicates.
COMPONENT = "((path LIKE '%.tsx' OR path LIKE '%.jsx') AND (contains(path, 'components') OR path LIKE '%/page.tsx' OR path LIKE '%/layout.tsx'))"
MARKUP = "(path LIKE '%.tsx' OR path LIKE '%.jsx')"
APP = "contains(path, 'src/app/')"
API = "(path LIKE '%/route.ts' OR path LIKE '%/route.js')"
PAGE = "(path LIKE '%/page.tsx' OR path LIKE '%/page.jsx')"
LAYOUT = "(path LIKE '%/layout.tsx' OR path LIKE '%/layout.jsx')"
SCRIPT = "(path LIKE '%.ts' OR path LIKE '%.tsx' OR path LIKE '%.js' OR path LIKE '%.jsx')"
TYPED = "(path LIKE '%.ts' OR path LIKE '%.tsx')"
EXCLUDED = "(" + " OR ".join(f"contains(path, '{x}')" for x in ("node_modules", ".git", "dist", "build", ".next", "__pycache__")) + ")"

#: Which files each engine looks at.
SCOPES = {"architectural": SCRIPT, "quality": SCRIPT, "typescript": TYPED, "framework": SCRIPT}


class Count(NamedTuple):
    patterns: list[str]
    flags: str = ""
    #: The same for dialects without look-around.
    plain: list[str] | None = None


# What is counted in a file, per name.
COUNTS: dict[str, Count] = {
    # architecture
    "metadata_exports": Count([r"export\s+(const\s+)?metadata\s*[:=]", r"export\s+(const\s+)?viewport\s*[:=]", r"export\s+async\s+function\s+generateMetadata"], "m"),
    "default_function": Count([r"export\s+default\s+function\s+(\w+)"]),
    "default_async_function": Count([r"export\s+default\s+async\s+function"]),
    # quality: components
    "function_component": Count([r"(export\s+default\s+)?function\s+\w+\s*\([^)]*\)\s*:\s*React\.ReactElement"]),
    "proper_props_interface": Count([r"interface\s+\w+Props\s*\{"]),
    "use_client_directive": Count([r"['\"]use client['\"]"]),
    "use_server_directive": Count([r"['\"]use server['\"]"]),
    "app_router_layout": Count([r"export\s+default\s+function\s+.*Layout\s*\("]),
    "app_router_page": Count([r"export\s+default\s+function\s+.*Page\s*\("]),
    "app_router_loading": Count([r"export\s+default\s+function\s+Loading\s*\("]),
    "app_router_error": Count([r"export\s+default\s+function\s+Error\s*\("]),
    "app_router_not_found": Count([r"export\s+default\s+function\s+NotFound\s*\("]),
    "suspense_usage": Count([r"<Suspense\s+fallback"]),
    "concurrent_features": Count([r"useDeferredValue\s*\(", r"useTransition\s*\(", r"startTransition\s*\(", r"React\.startTransition"]),
    "react_hooks": Count([rf"{h}\s*\(" for h in ("useState", "useEffect", "useCallback", "useMemo", "useContext", "useReducer", "useRef", "useImperativeHandle", "useLayoutEffect", "useDebugValue", "useId", "useSyncExternalStore", "useInsertionEffect")]),
    "custom_hooks": Count([r"use[A-Z]\w*\s*\("]),
    "server_component": Count([r"async\s+function\s+\w+\s*\([^)]*\)\s*:\s*Promise<"]),
    "server_only_import": Count([r"import\s+.*['\"]server-only['\"]"]),
    "client_only_import": Count([r"import\s+.*['\"]client-only['\"]"]),
    "forward_ref": Count([r"forwardRef\s*\("]),
    "react_portal": Count([r"createPortal\s*\("]),
    "context_provider": Count([r"\.Provider\s+value="]),
    "generic_components": Count([r"function\s+\w+<[^>]+>\s*\("]),
    "discriminated_props": Count([r"type\s+\w+Props\s*=\s*\{[^}]*\}\s*&\s*\("]),
    "as_prop_pattern": Count([r"as\?:\s*(keyof\s+JSX\.IntrinsicElements|React\.ElementType)"]),
    "memo_usage": Count([r"React\.memo\s*\("]),
    "lazy_loading": Count([r"React\.lazy\s*\(", r"dynamic\s*\(", r"import\s*\(['\"].*['\"]\)"]),
    "dangerous_html": Count([r"dangerouslySetInnerHTML"]),
    "console_log": Count([r"console\.(log|debug|info|warn|error)"]),
    "proper_validation": Count([r"zod\.", r"\.safeParse\(", r"joi\.", r"yup\."]),
    "aria_attributes": Count([r"aria-\w+"]),
    "semantic_html": Count([r"<(main|nav|header|footer|section|article|aside)", r"role=['\"]"]),
    "try_catch": Count([r"try\s*\{[^}]*\}\s*catch\s*\([^)]*\)\s*\{"], "s"),
    "async_try_catch": Count([r"try\s*\{[^}]*await[^}]*\}\s*catch\s*\([^)]*\)\s*\{"], "s"),
    "promise_catch": Count([r"\.catch\s*\("]),
    "error_boundary": Count([r"static\s+getDerivedStateFromError", r"componentDidCatch", r"ErrorBoundary", r"useErrorBoundary", r"withErrorBoundary"]),
    "resource_cleanup": Count([r"return\s*\(\s*\)\s*=>\s*\{", r"controller\.abort\(\)", r"clearInterval|clearTimeout", r"removeEventListener"]),
    # quality: recommendations
    "props_param": Count([r"function\s+\w+\s*\(\s*\{", r"=\s*\(\s*\{"]),
    "props_types": Count([r"interface\s+\w+Props", r"type\s+\w+Props\s*=", r"\}\s*:\s*\{"]),
    "map_without_key": Count([r"\.map\s*\([^)]*\)\s*=>.*<\w+(?!\s*key=)"], "s", [r"\.map\s*\([^)]*\)\s*=>.*<\w(?:\w|[^\w])"]),
    "client_features": Count([r"useState\s*\(", r"useEffect\s*\(", r"onClick", r"onSubmit", r"window\.", r"document\.", r"localStorage", r"sessionStorage"]),
    "data_fetching": Count([r"fetch\s*\(|await\s+"]),
    "async_function": Count([r"async\s+function"]),
    "effect_without_deps": Count([r"useEffect\s*\(\s*[^,)]+\s*\)"]),
    "react18": Count([r"Suspense|startTransition|useDeferredValue|useTransition"]),
    "expensive": Count([r"\.filter\(.*\.map\(|\.sort\(|for\s*\(.*length"]),
    "array_work": Count([r"\.filter\(|\.map\(|\.reduce\("]),
    "img_without_alt": Count([r"<img(?![^>]*alt=)"], "", []),
    "button_without_aria": Count([r"<button(?![^>]*aria-)"], "", []),
    "awaits": Count([r"await\s+"]),
    "try_blocks": Count([r"try\s*\{"]),
    "then_chains": Count([r"\.then\s*\([^)]*\)"]),
    "catch_chains": Count([r"\.catch\s*\([^)]*\)"]),
    "use_effects": Count([r"useEffect\s*\("]),
    "cleanup_returns": Count([r"return\s*\(\s*\)\s*=>"]),
    "needs_cleanup": Count([r"setInterval|setTimeout", r"addEventListener", r"subscribe|subscribe\(", r"new\s+WebSocket", r"new\s+EventSource"]),
    "has_boundary": Count([r"ErrorBoundary|componentDidCatch|getDerivedStateFromError"]),
    "async_components": Count([r"Suspense|lazy\(|React\.lazy"]),
    "fetch_calls": Count([r"fetch\s*\("]),
    "ok_checks": Count([r"\.ok\b|response\.status"]),
    # quality: bonuses
    "q_boundaries": Count([r"Suspense|ErrorBoundary|lazy\("]),
    "q_tests": Count([r"describe\(|test\(|it\(|expect\("]),
    "q_security": Count([r"helmet|cors|rate-?limit"]),
    "q_performance": Count([r"React\.memo|useCallback|useMemo|dynamic\("]),
    # typescript
    "return_types": Count([r"function\s+\w+\s*\([^)]*\)\s*:\s*\w+"]),
    "typed_parameters": Count([r"function\s+\w+\s*\([^)]*:\s*\w+[^)]*\)"]),
    "const_assertions": Count([r"as\s+const"]),
    "type_guards": Count([r"is\s+\w+"]),
    "generic_interfaces": Count([r"interface\s+\w+<[^>]+>"]),
    "proper_interfaces": Count([r"interface\s+[A-Z]\w*\s*\{"]),
    "type_aliases": Count([r"type\s+[A-Z]\w*\s*="]),
    "union_types": Count([r":\s*\w+\s*\|\s*\w+"]),
    "utility_types": Count([rf"\b{u}<" for u in ("Partial", "Required", "Readonly", "Record", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "Parameters", "ReturnType")]),
    "any_usage": Count([r":\s*any\b"]),
    "untyped_params": Count([r"function\s+\w+\s*\([^:)]*\w+[^:)]*\)"]),
    "no_return_type": Count([r"function\s+\w+\s*\([^:)]*\)\s*\{"]),
    "non_null": Count([r"!\s*\."]),
    "inline_objects": Count([r":\s*\{[^}]+\}"]),
    "object_utils": Count([r"function\s+\w+.*Object\.keys"]),
    "interfaces": Count([r"interface\s+\w+"]),
    "aliases": Count([r"type\s+\w+\s*="]),
    "functions": Count([r"function\s+\w+"]),
    "string_or_null": Count([r"string \| null"]),
    # framework
    "fw_page": Count([r"export\s+default\s+function\s+\w+.*\{\s*$"], "m"),
    "fw_layout": Count([r"export\s+default\s+function\s+\w+Layout"], "m"),
    "fw_loading": Count([r"export\s+default\s+function\s+Loading"], "m"),
    "fw_error": Count([r"export\s+default\s+function\s+Error"], "m"),
    "fw_not_found": Count([r"export\s+default\s+function\s+NotFound"], "m"),
    "static_metadata": Count([r"export\s+const\s+metadata\s*[:=]"]),
    "dynamic_metadata": Count([r"export\s+async\s+function\s+generateMetadata"]),
    "viewport": Count([r"export\s+const\s+viewport\s*[:=]"]),
    "form_action": Count([r"action=\{.*\}"]),
    "fw_context": Count([r"createContext\s*\("]),
    "fw_provider": Count([r"\.Provider"]),
    "fw_callback": Count([r"useCallback\s*\("]),
    "fw_memo_hook": Count([r"useMemo\s*\("]),
    "fw_lazy": Count([r"React\.lazy\s*\("]),
    "next_intl": Count([r"useTranslations\s*\("]),
    "locale_handling": Count([r"params:\s*\{\s*locale"]),
    "translation_keys": Count([r"t\s*\(['\"]"]),
    "auth_context": Count([r"AuthContext|useAuth"]),
    "jwt_handling": Count([r"jsonwebtoken|jwt"]),
    "session_management": Count([r"useSession|getSession"]),
    "api_methods": Count([rf"export\s+async\s+function\s+{m}" for m in ("GET", "POST", "PUT", "DELETE", "PATCH")]),
    "api_types": Count([r"\bNextRequest\b", r"\bNextResponse\b"]),
    "any_metadata": Count([r"export\s+(const\s+)?metadata"]),
    "hard_coded_text": Count([r">[^<{]*[a-zA-Z]{3,}[^<}]*<"]),
}

#: Counts that no pattern gives alone: the imports of a file as ``scan`` reads them, and effects that use more names than they list.
DERIVED = ("imports", "absolute_imports", "deep_relative", "ungrouped", "stale_effects")

# Engine, pattern name, pattern type, confidence, where, how many.
EMITTERS: list[tuple[str, str, str, float, str, str]] = [
    # the six shapes of an app router path, each of which counts
    ("architectural", "nextjs_app_router_structure", "architectural", 0.9, APP,
     "(CASE WHEN path LIKE 'src/app/[%]/%' AND split_part(path, '/', 3) LIKE '[_%]' THEN 1 ELSE 0 END"
     " + CASE WHEN path LIKE 'src/app/%/layout.ts' OR path LIKE 'src/app/%/layout.tsx' THEN 1 ELSE 0 END + CASE WHEN path LIKE 'src/app/%/page.ts' OR path LIKE 'src/app/%/page.tsx' THEN 1 ELSE 0 END"
     " + CASE WHEN path LIKE 'src/app/%/loading.ts' OR path LIKE 'src/app/%/loading.tsx' THEN 1 ELSE 0 END + CASE WHEN path LIKE 'src/app/%/error.ts' OR path LIKE 'src/app/%/error.tsx' THEN 1 ELSE 0 END"
     " + CASE WHEN path LIKE 'src/app/api/%/route.ts' OR path LIKE 'src/app/api/%/route.t' THEN 1 ELSE 0 END)"),
    ("architectural", "absolute_imports", "import", 0.9, "TRUE", "least(1, c_absolute_imports)"),
    ("architectural", "grouped_imports", "import", 0.8, "TRUE", "CASE WHEN c_imports > 0 AND c_ungrouped = 0 THEN 1 ELSE 0 END"),
    ("architectural", "nextjs_metadata_exports", "framework", 0.9, "TRUE", "c_metadata_exports"),
    ("architectural", "nextjs_default_export", "framework", 0.9, "(contains(path, '/page.') OR contains(path, '/layout.') OR contains(path, '/loading.') OR contains(path, '/error.'))", "least(1, c_default_function)"),
    ("architectural", "proper_directory_structure", "architectural", 0.7, "(contains(path, 'src/components/') OR contains(path, 'src/app/'))", "1"),
    ("architectural", "component_naming", "naming", 0.8, MARKUP + " AND substring(name, 1, 1) BETWEEN 'A' AND 'Z'", "1"),
    *[("quality", n, "component", 0.9, COMPONENT, f"c_{n}") for n in ("function_component", "proper_props_interface", "use_client_directive", "use_server_directive", "app_router_layout", "app_router_page", "app_router_loading", "app_router_error", "app_router_not_found", "suspense_usage", "custom_hooks", "server_component", "server_only_import", "client_only_import", "forward_ref", "react_portal", "context_provider", "generic_components", "discriminated_props", "as_prop_pattern")],
    ("quality", "react_hooks", "component", 0.8, COMPONENT, "c_react_hooks"),
    ("quality", "concurrent_features", "component", 0.8, COMPONENT, "c_concurrent_features"),
    ("quality", "memo_usage", "performance", 0.9, COMPONENT, "least(1, c_memo_usage)"),
    ("quality", "lazy_loading", "performance", 0.8, COMPONENT, "c_lazy_loading"),
    ("quality", "proper_validation", "security", 0.8, "TRUE", "c_proper_validation"),
    ("quality", "aria_attributes", "accessibility", 0.8, COMPONENT, "c_aria_attributes"),
    ("quality", "semantic_html", "accessibility", 0.7, COMPONENT, "c_semantic_html"),
    ("quality", "error_handling", "component", 0.8, "TRUE", "c_try_catch"),
    ("quality", "async_error_handling", "performance", 0.9, "TRUE", "c_async_try_catch"),
    ("quality", "promise_error_handling", "performance", 0.7, "TRUE", "c_promise_catch"),
    ("quality", "react_error_boundary", "component", 0.9, "TRUE", "c_error_boundary"),
    ("quality", "resource_cleanup", "performance", 0.8, "TRUE", "c_resource_cleanup"),
    ("typescript", "explicit_return_type", "type_safety", 0.9, "TRUE", "c_return_types"),
    ("typescript", "typed_parameters", "type_safety", 0.8, "TRUE", "c_typed_parameters"),
    ("typescript", "const_assertion", "type_safety", 0.9, "TRUE", "c_const_assertions"),
    ("typescript", "type_guard", "type_safety", 0.9, "TRUE", "c_type_guards"),
    ("typescript", "interface_definition", "type_safety", 0.9, "TRUE", "c_proper_interfaces"),
    ("typescript", "type_alias", "type_safety", 0.8, "TRUE", "c_type_aliases"),
    ("typescript", "union_type", "type_safety", 0.7, "TRUE", "c_union_types"),
    ("typescript", "generic_function", "type_safety", 0.9, "TRUE", "c_generic_components"),
    ("typescript", "generic_interface", "type_safety", 0.9, "TRUE", "c_generic_interfaces"),
    ("typescript", "utility_type", "type_safety", 0.9, "TRUE", "c_utility_types"),
    *[("framework", f"nextjs_{n}", "framework", 0.9, APP, f"c_fw_{n}") for n in ("page", "layout", "loading", "error", "not_found")],
    *[("framework", f"nextjs_{n}", "framework", 0.9, APP, f"c_{n}") for n in ("static_metadata", "dynamic_metadata", "viewport")],
    ("framework", "nextjs_server_action", "framework", 0.8, APP, "c_use_server_directive"),
    ("framework", "nextjs_form_action", "framework", 0.8, APP, "c_form_action"),
    ("framework", "react_hooks", "framework", 0.8, "TRUE", "c_custom_hooks"),
    ("framework", "react_context", "framework", 0.8, "TRUE", "c_fw_context"),
    ("framework", "react_provider", "framework", 0.8, "TRUE", "c_fw_provider"),
    ("framework", "react_forward_ref", "framework", 0.8, "TRUE", "c_forward_ref"),
    ("framework", "react_memo", "performance", 0.9, "TRUE", "c_memo_usage"),
    ("framework", "react_callback", "performance", 0.9, "TRUE", "c_fw_callback"),
    ("framework", "react_memo_hook", "performance", 0.9, "TRUE", "c_fw_memo_hook"),
    ("framework", "react_lazy", "performance", 0.9, "TRUE", "c_fw_lazy"),
    *[("framework", f"integration_{n}", "framework", 0.8, "TRUE", f"c_{n}") for n in ("next_intl", "locale_handling", "translation_keys")],
    *[("framework", f"integration_{n}", "security", 0.8, "TRUE", f"c_{n}") for n in ("auth_context", "jwt_handling", "session_management")],
    ("framework", "api_method_export", "framework", 0.9, API, "c_api_methods"),
    ("framework", "nextjs_api_types", "framework", 0.8, API, "c_api_types"),
]

# Engine, rule, severity, category, how many (0 where it does not fire).
_IF = "CASE WHEN {} THEN 1 ELSE 0 END"
RECOMMENDATIONS: list[tuple[str, str, str, str, str]] = [
    ("architectural", "PREFER_ABSOLUTE_IMPORTS", "warning", "import_organization", _IF.format("c_deep_relative > 0")),
    ("architectural", "GROUP_IMPORTS", "info", "import_organization", _IF.format("c_ungrouped > 0")),
    ("architectural", "COMPONENT_PASCAL_CASE", "warning", "naming_convention", _IF.format(MARKUP + " AND contains(path, 'components') AND NOT substring(name, 1, 1) BETWEEN 'A' AND 'Z'")),
    ("architectural", "STANDARD_DIRECTORY_STRUCTURE", "info", "file_structure", _IF.format("NOT (contains(path, 'src/') OR contains(path, 'app/') OR contains(path, 'components/') OR contains(path, 'lib/') OR contains(path, 'types/'))")),
    ("architectural", "MISSING_METADATA", "info", "nextjs_conventions", _IF.format("contains(path, '/layout.') AND NOT contains(content, 'metadata')")),
    ("architectural", "ASYNC_SERVER_COMPONENT", "warning", "nextjs_conventions", _IF.format("contains(path, '/page.') AND contains(content, 'async') AND NOT contains(content, 'use client') AND c_default_async_function = 0")),
    ("quality", "PREFER_FUNCTION_COMPONENTS", "info", "react_patterns", _IF.format(COMPONENT + " AND c_function_component = 0")),
    ("quality", "MISSING_PROPS_INTERFACE", "warning", "react_patterns", _IF.format(COMPONENT + " AND c_props_param > 0 AND c_props_types = 0")),
    ("quality", "MISSING_KEY_PROP", "warning", "react_performance", _IF.format(COMPONENT + " AND c_map_without_key > 0")),
    ("quality", "MISSING_USE_CLIENT", "warning", "nextjs_app_router", _IF.format(COMPONENT + " AND c_client_features > 0 AND c_use_client_directive = 0 AND NOT contains(path, 'layout.tsx')")),
    ("quality", "CONSIDER_SERVER_COMPONENT", "info", "react_server_components", _IF.format(COMPONENT + " AND c_use_client_directive = 0 AND c_data_fetching > 0 AND c_async_function = 0")),
    ("quality", "MISSING_USEEFFECT_DEPS", "warning", "react_hooks", _IF.format(COMPONENT + " AND c_effect_without_deps > 0")),
    ("quality", "CONSIDER_CONCURRENT_FEATURES", "info", "react_concurrent", _IF.format(COMPONENT + " AND c_react18 = 0 AND c_expensive > 0")),
    ("quality", "USE_CALLBACK_FOR_HANDLERS", "info", "performance", _IF.format(COMPONENT + " AND contains(content, 'onClick') AND NOT contains(content, 'useCallback')")),
    ("quality", "USE_MEMO_FOR_EXPENSIVE_OPS", "info", "performance", _IF.format(COMPONENT + " AND c_array_work > 0 AND NOT contains(content, 'useMemo')")),
    ("quality", "DANGEROUS_SET_INNER_HTML", "warning", "security", _IF.format("c_dangerous_html > 0")),
    ("quality", "REMOVE_CONSOLE_STATEMENTS", "info", "security", _IF.format("c_console_log > 0")),
    ("quality", "MISSING_ALT_TEXT", "warning", "accessibility", _IF.format(COMPONENT + " AND c_img_without_alt > 0")),
    ("quality", "MISSING_ARIA_LABELS", "info", "accessibility", _IF.format(COMPONENT + " AND c_button_without_aria > 0 AND contains(content, 'onClick')")),
    ("quality", "MISSING_ASYNC_ERROR_HANDLING", "error", "async_error_handling", _IF.format("c_awaits > 0 AND c_try_blocks = 0")),
    ("quality", "MISSING_PROMISE_CATCH", "warning", "promise_error_handling", _IF.format("c_catch_chains < c_then_chains")),
    ("quality", "MISSING_USEEFFECT_CLEANUP", "warning", "resource_cleanup", _IF.format("c_use_effects > 0 AND c_needs_cleanup > 0 AND c_cleanup_returns = 0")),
    ("quality", "MISSING_ERROR_BOUNDARY", "info", "react_error_handling", _IF.format(COMPONENT + " AND c_async_components > 0 AND c_has_boundary = 0")),
    ("quality", "MISSING_FETCH_ERROR_CHECK", "warning", "api_error_handling", _IF.format("c_fetch_calls > 0 AND c_ok_checks = 0 AND c_try_blocks = 0")),
    ("typescript", "AVOID_ANY_TYPE", "warning", "type_safety", _IF.format("c_any_usage > 0")),
    ("typescript", "ADD_PARAMETER_TYPES", "info", "type_safety", "c_untyped_params"),
    ("typescript", "ADD_RETURN_TYPES", "info", "type_safety", "c_no_return_type"),
    ("typescript", "EXCESSIVE_NON_NULL_ASSERTIONS", "warning", "type_safety", _IF.format("c_non_null > 3")),
    ("typescript", "EXTRACT_INLINE_TYPES", "info", "type_organization", _IF.format("c_inline_objects > 2")),
    ("typescript", "CREATE_TYPE_ALIAS", "info", "type_organization", _IF.format("c_string_or_null > 3")),
    ("typescript", "USE_GENERICS_FOR_OBJECT_UTILS", "info", "generics", _IF.format("c_object_utils > 0 AND NOT contains(content, '<')")),
    ("framework", "MISSING_LAYOUT_METADATA", "info", "nextjs_seo", _IF.format(LAYOUT + " AND c_any_metadata = 0")),
    ("framework", "MISSING_API_ERROR_HANDLING", "warning", "nextjs_api", _IF.format(API + " AND NOT (contains(content, 'try') AND contains(content, 'catch'))")),
    ("framework", "USE_NEXT_RESPONSE", "info", "nextjs_api", _IF.format(API + " AND NOT contains(content, 'NextResponse')")),
    ("framework", "MISSING_USE_CLIENT", "warning", "nextjs_components", _IF.format("path LIKE '%.tsx' AND contains(path, 'components') AND c_client_features > 0 AND c_use_client_directive = 0")),
    ("framework", "MISSING_KEY_PROP", "warning", "react_performance", _IF.format("contains(content, '.map(') AND NOT contains(content, 'key=')")),
    ("framework", "REVIEW_EFFECT_DEPENDENCIES", "info", "react_hooks", "c_stale_effects"),
    ("framework", "INTERNATIONALIZE_TEXT", "info", "internationalization", _IF.format("contains(content, 'useTranslations') AND c_hard_coded_text > 2")),
    ("framework", "MISSING_SUSPENSE_BOUNDARY", "info", "react_async", _IF.format("contains(content, 'async') AND NOT contains(content, 'Suspense') AND path LIKE '%.tsx'")),
]
#: Rules whose place is computed by dividing by the length of the first line: they fail where it is empty.
FRAGILE = ("MISSING_ASYNC_ERROR_HANDLING", "MISSING_PROMISE_CATCH", "MISSING_USEEFFECT_CLEANUP", "MISSING_FETCH_ERROR_CHECK")

# Score folds.
BASE_SCORE = {"architectural": "0.6", "quality": "0.7", "typescript": "0.5", "framework": f"(CASE WHEN {API} THEN 0.7 WHEN {PAGE} OR {LAYOUT} THEN 0.65 ELSE 0.6 END)"}
PENALTY = {
    "architectural": {"info": 0.02, "warning": 0.05, "error": 0.15, "critical": 0.25},
    "quality": {"info": 0.01, "warning": 0.05, "error": 0.12, "critical": 0.20},
    "typescript": {"info": 0.02, "warning": 0.08, "error": 0.15, "critical": 0.25},
    "framework": {"info": 0.02, "warning": 0.08, "error": 0.15, "critical": 0.25},
}
#: Bonus by pattern name or, for quality, by pattern type; the last is for all others.
BONUS: dict[str, tuple[dict[str, float], float]] = {
    "architectural": ({"nextjs_app_router_structure": 0.15, "nextjs_metadata_exports": 0.1, "absolute_imports": 0.1, "component_naming": 0.05, "proper_directory_structure": 0.05, "grouped_imports": 0.05}, 0.02),
    "quality": ({"component": 0.08, "performance": 0.12, "security": 0.15, "accessibility": 0.10, "architectural": 0.06, "type_safety": 0.08}, 0.03),
    "typescript": ({"explicit_return_type": 0.1, "typed_parameters": 0.08, "interface_definition": 0.1, "type_alias": 0.08, "generic_function": 0.12, "generic_interface": 0.12, "utility_type": 0.1, "type_guard": 0.15, "const_assertion": 0.05}, 0.02),
    "framework": ({"nextjs_page": 0.1, "nextjs_layout": 0.1, "nextjs_static_metadata": 0.15, "nextjs_dynamic_metadata": 0.2, "nextjs_server_action": 0.1, "react_hooks": 0.05, "react_memo": 0.08, "react_callback": 0.08, "integration_next_intl": 0.1, "integration_auth_context": 0.1, "api_method_export": 0.15, "nextjs_api_types": 0.1}, 0.02),
}
QUALITY_BONUS = (
    "(CASE WHEN contains(content, 'strict') THEN 0.1 ELSE 0 END + CASE WHEN contains(content, 'use client') THEN 0.05 ELSE 0 END + CASE WHEN contains(content, 'use server') THEN 0.05 ELSE 0 END"
    " + CASE WHEN c_q_boundaries > 0 THEN 0.08 ELSE 0 END + CASE WHEN c_q_tests > 0 THEN 0.1 ELSE 0 END + CASE WHEN c_q_security > 0 THEN 0.08 ELSE 0 END"
    " + CASE WHEN c_q_performance > 0 THEN 0.06 ELSE 0 END + least(0.1, c_aria_attributes * 0.02))"
)
STRICT_TYPING = (
    "(CASE WHEN c_functions = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, CAST(c_return_types AS DOUBLE) / greatest(1, c_functions)"
    " - least(0.3, c_any_usage * 0.05) + least(0.2, (c_interfaces + c_aliases) * 0.02))) END)"
)
