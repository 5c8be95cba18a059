"""Patterns of the domain classifier, as Java regular expressions without flags."""

from __future__ import annotations

# Patterns of paths, per domain; matched from the start, ignoring case.
PATHS: dict[str, list[str]] = {
    "backend": [
        r"src/app/api/.*\.ts$",
        r"src/api/.*\.(ts|js)$",
        r"api/.*\.(ts|js)$",
        r"server/.*\.(ts|js|py)$",
        r"backend/.*\.(ts|js|py)$",
        r"src/lib/.*\.ts$",
        r".*\.server\.(ts|js)$",
        r".*routes.*\.(ts|js|py)$",
        r".*controllers.*\.(ts|js|py)$",
        r".*services.*\.(ts|js|py)$",
    ],
    "frontend": [
        r"src/components/.*\.(tsx?|jsx?)$",
        r"src/pages/.*\.(tsx?|jsx?)$",
        r"src/app/(?!api).*\.(tsx?|jsx?)$",
        r"components/.*\.(tsx?|jsx?)$",
        r"src/contexts/.*\.(tsx?|jsx?)$",
        r"src/hooks/.*\.(tsx?|jsx?)$",
        r"src/types/.*\.(ts|tsx)$",
        r"src/utils/.*\.(tsx?|jsx?)$",
        r"src/(?!api/|lib/|utils\.)[^/]*\.(tsx?|jsx?)$",
        r".*\.css$",
        r".*\.scss$",
        r".*\.less$",
        r"src/styles/.*",
        r"public/.*",
    ],
    "database": [
        r".*migrations?/.*\.(sql|ts|js|py)$",
        r".*models?/.*\.(ts|js|py)$",
        r".*schema.*\.(ts|js|py|sql)$",
        r"(^|.*/)?database/.*\.(ts|js|py|sql)$",
        r".*\.sql$",
        r"prisma/.*",
        r".*drizzle.*",
    ],
    "infrastructure": [
        r".*dockerfile.*$",
        r".*docker-compose.*\.(yml|yaml)$",
        r".*\.dockerignore$",
        r".*\.github/.*\.(yml|yaml)$",
        r".*infrastructure/.*",
        r".*deploy.*\.(yml|yaml|sh)$",
        r".*terraform.*\.(tf|tfvars)$",
        r".*ansible.*\.(yml|yaml)$",
        r".*kubernetes.*\.(yml|yaml)$",
    ],
    "testing": [
        r".*\.test\.(ts|tsx|js|jsx|py)$",
        r".*\.spec\.(ts|tsx|js|jsx|py)$",
        r"(^|.*/)(tests?|__tests__)(/.*)?$",
        r".*jest\.(config|setup)\.(ts|tsx|js|jsx)$",
        r".*vitest\.(config|setup)\.(ts|tsx|js|jsx)$",
        r".*cypress.*",
        r".*playwright.*",
        r".*e2e.*",
    ],
    "configuration": [
        r"(^|.*/)(constants?|config)(/.*)?$",
        r".*\.config\.(ts|js|json)$",
        r".*\.json$",
        r".*\.env.*$",
        r".*package\.json$",
        r".*tsconfig.*\.json$",
        r".*\.eslintrc.*$",
        r".*\.prettierrc.*$",
        r".*next\.config\.(ts|js)$",
        r".*tailwind\.config\.(ts|js)$",
    ],
    "documentation": [
        r".*\.md$",
        r".*\.mdx$",
        r".*readme.*$",
        r".*changelog.*$",
        r".*\.txt$",
        r"docs?/.*",
    ],
}

# Patterns of imports, per domain; searched by line, ignoring case.
IMPORTS: dict[str, list[str]] = {
    "frontend": [
        r"import.*from\s+['\"]react['\"]",
        r"import.*from\s+['\"]next/.*['\"]",
        r"import.*from\s+['\"]@/components/.*['\"]",
        r"['\"]use client['\"]",
        r"import.*useState|useEffect|useCallback",
        r"import.*from\s+['\"]styled-components['\"]",
        r"import.*from\s+['\"]@emotion/.*['\"]",
        r"useDeferredValue|useTransition|useId",
        r"Suspense|ErrorBoundary|startTransition",
        r"import.*from\s+['\"]client-only['\"]",
        r"forwardRef|createPortal",
        r"import.*from\s+['\"]next/navigation['\"]",
        r"useRouter|useSearchParams|usePathname",
        r"import.*from\s+['\"]tailwindcss['\"]",
        r"className=|tw\.|clsx\(|cn\(",
        r"import.*from\s+['\"]zustand['\"]",
        r"import.*from\s+['\"]jotai['\"]",
        r"import.*from\s+['\"]@tanstack/react-query['\"]",
    ],
    "backend": [
        r"import.*from\s+['\"]next/server['\"]",
        r"NextRequest|NextResponse",
        r"import.*from\s+['\"]express['\"]",
        r"import.*from\s+['\"]fastify['\"]",
        r"import.*from\s+['\"]koa['\"]",
        r"import.*from\s+['\"]node:.*['\"]",
        r"import.*fs|path|crypto",
        r"['\"]use server['\"]",
        r"import.*from\s+['\"]server-only['\"]",
        r"cookies\(\)|headers\(\)",
        r"redirect\(|notFound\(\)",
        r"import.*from\s+['\"]@vercel/.*['\"]",
        r"import.*from\s+['\"]@planetscale/.*['\"]",
        r"import.*from\s+['\"]@supabase/.*['\"]",
        r"import.*from\s+['\"]next-auth.*['\"]",
        r"import.*from\s+['\"]@auth/.*['\"]",
        r"middleware\.(ts|js)",
        r"cors|helmet|morgan|ratelimit",
    ],
    "database": [
        r"import.*from\s+['\"]prisma/.*['\"]",
        r"import.*from\s+['\"]drizzle-orm.*['\"]",
        r"import.*from\s+['\"]mongoose['\"]",
        r"import.*from\s+['\"]typeorm['\"]",
        r"import.*from\s+['\"]sequelize['\"]",
        r"import.*from\s+['\"]pg['\"]",
        r"import.*from\s+['\"]mysql.*['\"]",
        r"import.*from\s+['\"]@prisma/client['\"]",
        r"import.*from\s+['\"]drizzle-kit['\"]",
        r"import.*from\s+['\"]kysely['\"]",
        r"import.*from\s+['\"]@planetscale/database['\"]",
        r"import.*from\s+['\"]@supabase/supabase-js['\"]",
        r"import.*from\s+['\"]redis['\"]",
        r"import.*from\s+['\"]ioredis['\"]",
        r"import.*from\s+['\"]@vercel/postgres['\"]",
        r"import.*from\s+['\"]@neondatabase/serverless['\"]",
        r"PrismaClient|DrizzleClient|DatabaseClient",
    ],
    "testing": [
        r"import.*from\s+['\"]@testing-library/.*['\"]",
        r"import.*from\s+['\"]jest['\"]",
        r"import.*from\s+['\"]vitest['\"]",
        r"import.*from\s+['\"]cypress['\"]",
        r"import.*from\s+['\"]playwright['\"]",
        r"describe|test|it|expect",
        r"import.*from\s+['\"]@playwright/test['\"]",
        r"import.*from\s+['\"]@storybook/.*['\"]",
        r"import.*from\s+['\"]msw['\"]",
        r"import.*from\s+['\"]@faker-js/faker['\"]",
        r"import.*from\s+['\"]factory-girl['\"]",
        r"beforeEach|afterEach|beforeAll|afterAll",
        r"mock|spy|stub|vi\.mock",
        r"render|screen\.|fireEvent|userEvent",
        r"waitFor|findBy|queryBy|getBy",
        r"page\.|locator\.|goto\(|click\(",
        r"test\.describe|test\.beforeEach",
    ],
}

# Patterns of content, per domain; counted by line, ignoring case.
CONTENT: dict[str, list[str]] = {
    "frontend": [
        r"return\s*\(\s*<",
        r"<\w+.*>",
        r"className=",
        r"onClick=|onChange=|onSubmit=",
        r"React\.FC|FC<",
        r"useState|useEffect|useContext",
        r"Suspense.*fallback=",
        r"startTransition\(|useDeferredValue\(",
        r"useId\(|useTransition\(",
        r"params:|searchParams:",
        r"generateMetadata|generateStaticParams",
        r"layout\.tsx|page\.tsx|loading\.tsx",
        r"forwardRef<.*>|createPortal\(",
        r"memo\(.*\)|useCallback\(.*\)|useMemo\(",
        r"clsx\(|cn\(|tw\.|@apply",
        r"variants:|compoundVariants:",
        r"useForm\(|register\(|handleSubmit",
        r"zodResolver|yupResolver",
        r"useStore\(|atom\(|selector\(",
        r"create\(.*=>\s*\{",
    ],
    "backend": [
        r"export\s+async\s+function\s+(GET|POST|PUT|DELETE|PATCH)",
        r"req\.|res\.|request\.|response\.",
        r"\.json\(\)|\.status\(\)",
        r"async\s+function.*handler",
        r"middleware",
        r"cors|helmet|morgan",
        r"NextRequest|NextResponse",
        r"cookies\(\)\.set|headers\(\)\.get",
        r"redirect\(|notFound\(\)",
        r"['\"]use server['\"]",
        r"revalidatePath\(|revalidateTag\(",
        r"process\.env\.|Bun\.|Deno\.",
        r"jwt\.sign|bcrypt\.|scrypt\.",
        r"getServerSession|auth\(\)",
        r"await\s+db\.|await\s+prisma\.",
        r"z\.|zod\.|validator\.",
    ],
    "database": [
        r"SELECT|INSERT|UPDATE|DELETE|CREATE TABLE",
        r"\.findMany\(\)|\.findUnique\(\)|\.create\(\)|\.update\(\)",
        r"schema\.|model\.|entity\.",
        r"migration|migrate",
        r"connection|connect|disconnect",
        r"\.query\(|\.execute\(|\.transaction\(",
        r"\.select\(\)|\.where\(\)|\.orderBy\(",
        r"\.join\(|\.leftJoin\(|\.innerJoin\(",
        r"@Entity\(|@Table\(|@Column\(",
        r"PrismaClient\(\)|DrizzleClient\(\)",
        r"upsert\(|deleteMany\(|updateMany\(",
        r"aggregate\(|groupBy\(|count\(\)",
        r"relations\(|references\(|primaryKey\(",
        r"varchar\(|integer\(|boolean\(|timestamp\(",
        r"createTable\(|dropTable\(|alterTable\(",
        r"addColumn\(|dropColumn\(|addIndex\(",
    ],
    "testing": [
        r"describe\(|test\(|it\(",
        r"expect\(.*\)\.(toBe|toEqual|toContain)",
        r"beforeEach|afterEach|beforeAll|afterAll",
        r"mock|spy|stub",
        r"render\(|screen\.|fireEvent",
        r"vi\.mock\(|vi\.spyOn\(|vi\.fn\(",
        r"waitFor\(|findBy|queryBy|getBy",
        r"userEvent\.|fireEvent\.",
        r"toHaveBeenCalled|toHaveBeenCalledWith",
        r"toBeInTheDocument\(|toHaveClass\(",
        r"page\.goto\(|page\.click\(|page\.fill\(",
        r"locator\(|getByRole\(|getByText\(",
        r"expect\(page\)\.|await page\.",
        r"mount\(|shallow\(|render\(",
        r"wrapper\.find\(|wrapper\.prop\(",
        r"supertest\(|request\(.*\)\.",
        r"\.get\(|\.post\(|\.put\(|\.delete\(",
        r"jest\.mock\(|jest\.spyOn\(",
        r"mockResolvedValue|mockRejectedValue",
        r"msw\.|setupServer\(|rest\.",
    ],
}
