from depthloom.cli import main

raise SystemExit(main())
