"""Relations of the impact graph, and the fixed tables that classification and extraction use."""

from __future__ import annotations

from pyspark.sql import types as T

IDENTIFIER = T.StructType([T.StructField("id_kind", T.StringType()), T.StructField("key", T.StringType())])
METHOD = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("a11y_queries", T.ArrayType(IDENTIFIER)), T.StructField("referenced_types", T.ArrayType(T.StringType()))]
)
NODES = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("defined_symbols", T.ArrayType(T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("a11y_setters", T.ArrayType(IDENTIFIER)),
        T.StructField("a11y_queries", T.ArrayType(IDENTIFIER)),
        T.StructField("test_methods", T.ArrayType(METHOD)),
    ]
)
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "dst", "kind")] + [T.StructField("ordinal", T.LongType())])
METADATA = T.StructType(
    [
        T.StructField("repo_root", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("edge_count", T.LongType()),
        T.StructField("data_sources_used", T.ArrayType(T.StringType())),
    ]
)
PARSED = T.StructType(
    [T.StructField("file_id", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("defines", "references", "view_embeddings", "imports")]
    + [T.StructField("role", T.StringType())]
    + [T.StructField(n, T.ArrayType(IDENTIFIER)) for n in ("a11y_setters", "a11y_queries")]
    + [T.StructField("test_methods", T.ArrayType(METHOD))]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("constants", "typealiases")]
)
INDEX_FILE = T.StructType(
    [
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType())]))),
        T.StructField("fileCount", T.LongType()),
        T.StructField("edgeCount", T.LongType()),
    ]
)

DIRECT, VIEW, A11Y = "DirectReference", "ViewEmbedding", "AccessibilityBinding"

# Test kinds in the order of every output, their role, and the edge kinds that each may follow.
KINDS = ("Unit", "Snapshot", "UITest")
ROLE_OF_KIND = {"Unit": "UnitTest", "Snapshot": "SnapshotTest", "UITest": "UITest"}
EDGES_OF_KIND = {"Unit": (DIRECT,), "Snapshot": (DIRECT, VIEW), "UITest": (DIRECT, VIEW, A11Y)}

# Folders that a listing of tracked files leaves out.
SKIPPED_TRACKED = (
    "/DerivedData/", "/derived-data/", "/build/", "/.build/", "/Pods/", "/Carthage/",
    "/SourcePackages/checkouts/", "/checkouts/", "/caches/", "/.swiftpm/",
)
# The same for a walk of a folder.
SKIPPED_WALKED = ("/DerivedData/", "/derived-data/", "/build/", "/.build/", "/Pods/", "/Carthage/", "/checkouts/", "/caches/", "/.swiftpm/")
# What endpoints of symbol-index edges may not contain, begin with or end with.
SKIPPED_INDEXED = ("/DerivedData/", "/derived-data/", "/build/", "/.build/", "/checkouts/", "/caches/", "/Pods/", "/Carthage/", ".swiftmodule/", ".swiftinterface")
SKIPPED_INDEXED_START = ("/Applications/", "/usr/")
SKIPPED_INDEXED_END = (".h", ".m", ".pbobjc.h")
# What inputs of dependency files may not contain.
SKIPPED_INPUTS = ("/Xcode.app/", "/SDKs/", "/usr/lib/", "/.build/", "/SourcePackages/checkouts/")

# Imports that make a file a snapshot test.
SNAPSHOT_IMPORTS = ("SnapshotTesting", "iOSSnapshotTestCase", "FBSnapshotTestCase", "SnapshotTestingSupport")

# Suffixes of identifiers, the first that fits goes.
ACCESSOR_SUFFIXES = (".rawValue", ".id", ".identifier", ".value")

# Properties of a test application whose call with an identifier is a query.
QUERY_ACCESSORS = (
    "buttons", "staticTexts", "textFields", "textViews", "switches", "sliders", "images", "cells", "tables",
    "collectionViews", "otherElements", "scrollViews", "alerts", "sheets", "navigationBars", "tabBars", "toolbars",
    "searchFields", "activityIndicators", "progressIndicators", "segmentedControls", "pickers", "datePickers",
    "steppers", "webViews", "maps", "links", "icons", "checkBoxes", "radioButtons", "menuItems", "menus", "popovers",
    "draggableFiles",
)

# Project names too common to join on.
AMBIGUOUS_NAMES = (
    "Constants", "Strings", "Config", "Configuration", "Context", "State", "Action", "Event", "Kind", "Style", "Theme",
    "Model", "ViewModel", "Interactor", "Router", "Builder", "Factory", "Mapper", "Coordinator", "Presenter",
    "Provider", "Service", "Repository", "Manager", "Handler", "Delegate", "DataSource", "Request", "Response",
    "Section", "Item", "Cell",
)
# Names of the language and its standard library.
LANGUAGE_NAMES = (
    "String", "Int", "Int8", "Int16", "Int32", "Int64", "UInt", "UInt8", "UInt16", "UInt32", "UInt64", "Double",
    "Float", "Float16", "Bool", "Array", "Dictionary", "Set", "Optional", "Any", "AnyObject", "AnyHashable",
    "AnyClass", "Void", "Never", "Data", "Date", "URL", "UUID", "Error", "Result", "Character", "Substring", "Range",
    "ClosedRange", "PartialRangeFrom", "Codable", "Encodable", "Decodable", "Hashable", "Equatable", "Comparable",
    "Identifiable", "Sendable", "CustomStringConvertible", "CustomDebugStringConvertible", "RawRepresentable",
    "CaseIterable", "IteratorProtocol", "Sequence", "Collection", "RandomAccessCollection",
    "BidirectionalCollection", "ExpressibleByStringLiteral", "ExpressibleByIntegerLiteral",
    "ExpressibleByArrayLiteral", "ExpressibleByDictionaryLiteral", "LosslessStringConvertible", "View", "some",
    "Self", "Type",
)
# Names of the platform's foundation libraries.
FOUNDATION_NAMES = (
    "NSObject", "NSCoding", "NSSecureCoding", "NSCopying", "NSError", "NSString", "NSNumber", "NSArray",
    "NSDictionary", "NSNotification", "Notification", "NotificationCenter", "JSONEncoder", "JSONDecoder",
    "PropertyListEncoder", "PropertyListDecoder", "DispatchQueue", "DispatchGroup", "DispatchSemaphore",
    "OperationQueue", "Operation", "UserDefaults", "FileManager", "Bundle", "ProcessInfo", "Timer", "TimeInterval",
    "DateFormatter", "DateComponents", "Calendar", "Locale", "TimeZone", "URLRequest", "URLResponse", "URLSession",
    "URLSessionTask", "HTTPURLResponse",
)
# Names of the view-controller toolkit.
TOOLKIT_NAMES = (
    "UIView", "UIViewController", "UINavigationController", "UITabBarController", "UITableView", "UITableViewCell",
    "UICollectionView", "UICollectionViewCell", "UITableViewDataSource", "UITableViewDelegate",
    "UICollectionViewDataSource", "UICollectionViewDelegate", "UILabel", "UIButton", "UIImageView", "UIImage",
    "UITextField", "UITextView", "UISwitch", "UISlider", "UIStackView", "UIScrollView", "UIControl", "UIColor",
    "UIFont", "UIEdgeInsets", "UIApplication", "UIWindow", "UIScene", "UIScreen", "UIStoryboard",
    "UIStoryboardSegue", "UINib", "UIBarButtonItem", "UIAlertController", "UIAlertAction", "UIGestureRecognizer",
    "UITapGestureRecognizer", "UILongPressGestureRecognizer", "UIPanGestureRecognizer", "UIResponder", "UIEvent",
    "UITouch", "CGFloat", "CGPoint", "CGSize", "CGRect", "CGAffineTransform", "NSLayoutConstraint", "NSLayoutAnchor",
)
# Names of the declarative view, event and test libraries.
DECLARATIVE_NAMES = (
    "State", "Binding", "ObservedObject", "StateObject", "EnvironmentObject", "Environment", "Published",
    "ObservableObject", "PreviewProvider", "App", "Scene", "WindowGroup", "NavigationView", "NavigationLink", "List",
    "ForEach", "HStack", "VStack", "ZStack", "LazyVStack", "LazyHStack", "Text", "Image", "Button", "Toggle", "Slider",
    "Picker", "Label", "Spacer", "Divider", "EmptyView", "AnyView", "ScrollView", "ScrollViewReader", "TabView",
    "NavigationStack", "Menu", "ProgressView", "ContentUnavailableView", "Section", "ToolbarItem",
    "ToolbarItemGroup", "DisclosureGroup", "Group", "Color", "Font", "EdgeInsets", "Alignment", "GeometryReader",
    "GeometryProxy", "ViewModifier", "ViewBuilder", "Task", "MainActor", "Publisher", "Subscriber", "Subscription",
    "AnyPublisher", "AnyCancellable", "Cancellable", "PassthroughSubject", "CurrentValueSubject", "Future",
    "XCTestCase", "XCTestExpectation", "XCTAssert", "XCUIApplication", "XCUIElement", "XCUIElementQuery",
)
# The text of the warning about a large cycle, before and after its first files.
CYCLE_WARNING = ("Dependency cycle detected (", " files):\n  ", " -> ...\n  These files will always be tested together, reducing TIA effectiveness.\n  Consider breaking the cycle to improve test isolation.")
BUILTIN_NAMES = frozenset((*AMBIGUOUS_NAMES, *LANGUAGE_NAMES, *FOUNDATION_NAMES, *TOOLKIT_NAMES, *DECLARATIVE_NAMES))
